"""The pipeline's stages and its run against brute force, on rows with nulls,
empty texts, repeated rows, clashing columns, and on an empty table."""

import collections
import os
import random
import re

import public_tokenizers
import pytest

import corpus_pipeline
from civicspark.llm import common, pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lost long, __q_kept string, n_words long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = "the committee shall publish its yearly report on water quality before the end of march each year"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(n))


def make_rows():
    rng, rows = random.Random(4), []
    base = [prose(rng, 80) + ".\n" + prose(rng, 40) + "." for _ in range(12)]
    shared = prose(rng, 15)
    rows += [(k, t, "en" if k % 2 else None, "web", len(t)) for k, t in enumerate(base)]
    rows += [(20, base[0], "en", "web", 1), (21, base[1].replace("a", "b", 1), "en", None, 2), (22, base[2] + "\n" + PASSAGE, "de", "web", 3)]
    rows += [(30, prose(rng, 60) + "\n" + shared, "en", "web", 4), (31, prose(rng, 60) + "\n" + shared + "\n" + prose(rng, 12), "en", "web", 5)]
    rows += [(40, None, None, None, None), (41, "", "en", "web", 0), (42, "\t\n ", "en", "web", 3), (43, "too short", "en", "web", 9), (44, "spam " * 90, "en", "web", 450)]
    rows += [(50, base[5], "en", "web", len(base[5]))] * 2 + [(None, prose(rng, 70), "en", "web", 7)] * 2 + [(None, prose(rng, 70), "en", "web", 8)]
    return [(*r, 7, "own", 9) for r in rows]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(ROWS, SCHEMA).repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/none.parquet")
    return path


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_base_rules(spark, docs, folder):
    out = pipeline.quality_rules(spark, docs, folder)
    assert out.columns == docs.columns

    def failed(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        g = collections.Counter(zip(w, w[1:], w[2:]))
        cov = {k for i in range(len(w) - 2) if g[tuple(w[i:i + 3])] > 1 for k in range(i, i + 3)}
        return len(w) < 50 or 100 * len(cov) > 50 * len(w)

    passed = [r for r in ROWS if not failed(r[1])]
    length = sorted(10 * sum(map(len, w)) // len(w) for w in (re.findall(r"[^\x20\x09-\x0D]+", r[1]) for r in passed))
    got = rows_of(out)
    assert set(got) <= set(passed) and len(got) >= 0.9 * len(passed)  # plain documents: a fence may take the outermost
    assert all(10 * sum(map(len, w)) // len(w) in (length[-1], length[-2]) for w in (words(r[1]) for r in passed if r not in got))


def test_lines(spark, docs, folder):
    out = pipeline.lines(spark, docs, folder)
    assert out.columns == docs.columns
    texts = collections.Counter(line for r in out.collect() for line in (r.text or "").split("\n") if line.strip())
    repeated = {t for i in {50} for t in ROWS[[r[0] for r in ROWS].index(i)][1].split("\n")} | {t for r in ROWS if r[0] is None for t in r[1].split("\n")}
    assert all(n == 1 for t, n in texts.items() if t not in repeated)  # whole rows that repeat keep their lines
    near = lambda a, b: len(set(zip(*[a[i:] for i in range(7)])) & set(zip(*[b[i:] for i in range(7)]))) / max(1, len(set(zip(*[a[i:] for i in range(7)])) | set(zip(*[b[i:] for i in range(7)]))))
    kept = list(texts)
    assert not [(a, b) for i, a in enumerate(kept) for b in kept[:i] if near(a, b) >= 0.9]
    for r in out.filter("text is not null and doc_id is not null").collect():
        was = next(x for x in ROWS if x[0] == r.doc_id)
        assert r.n_lost == 7 and r["__q_kept"] == "own"
        assert r.n_chars == (was[4] if r.text == was[1] else len(r.text))


def test_near_duplicates(spark, docs, folder):
    out = pipeline.near_duplicates(spark, docs, folder)
    assert out.columns == docs.columns
    distinct = sorted({(r[0], r[1]) for r in ROWS if words(r[1])}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    sets, group = [shingles(t) for _, t in distinct], list(range(len(distinct)))
    for i in range(len(distinct)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    stay = collections.Counter(distinct[g][0] for g in set(group))
    got = collections.Counter(r.doc_id for r in out.collect() if words(r.text))
    assert got == stay
    assert sum(1 for r in out.collect() if not words(r.text)) == sum(1 for r in ROWS if not words(r[1]))


def test_benchmark(spark, docs, folder):
    w = words(PASSAGE)
    windows = {tuple(w[i:i + 10]) for i in range(len(w) - 9)}
    out = pipeline.benchmark(spark, docs, folder)
    assert rows_of(out) == sorted((r for r in ROWS if not windows & shingles(r[1], 10)), key=repr) and out.count() == len(ROWS) - 1


def test_run_packs_what_the_stages_keep(spark, folder):
    root = common.scratch_root(spark).split(":", 1)[-1].replace("//", "")
    before = set(os.listdir(f"{root}/llm")) if os.path.isdir(f"{root}/llm") else set()
    out = corpus_pipeline.run(spark, folder)
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(f"{root}/llm")) - before] == ["pipeline-packing"]  # the result alone stays
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter((r.doc_id, len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    got = collections.Counter()
    for r in out.collect():
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == collections.Counter({k: k[1] * n for k, n in want.items()}) and len(got) > 10


def test_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/none.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_scratch_goes_when_a_stage_is_given_its_stored_result(spark, docs, folder, tmp_path):
    first = pipeline.near_duplicates(spark, docs, folder)
    pipeline.near_duplicates(spark, docs, folder)  # not the result of the first
    assert first.count() > 0
    first.write.parquet(f"{tmp_path}/out")
    pipeline.benchmark(spark, spark.read.parquet(f"{tmp_path}/out"), folder)
    with pytest.raises(Exception):
        first.count()
