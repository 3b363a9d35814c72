"""Recall of the fuzzy line search by length, against exact Jaccard."""

import random

import pytest

from civicspark.llm import graph, line_dedup

CLASSES = {"short": (24, 48), "middle": (80, 160), "long": (300, 600)}


def shingles(line, size=line_dedup.SHINGLE):
    return {line[i:i + size] for i in range(len(line) - size + 1)} or {line}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def pairs(rng, low, high, n):
    """Pairs of lines at a similarity of 0.8 to 0.9."""
    letters, out = "abcdefghijklmnopqrstuvwxyz    ", []
    while len(out) < n:
        a = "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
        a = "x" + " ".join(a.split())
        b = list(a)
        for _ in range(rng.randint(1, max(1, len(a) // 60))):
            b[rng.choice([rng.randrange(len(b)), len(b) - 1 - rng.randrange(4)])] = rng.choice("0123456789")
        b = "".join(b)
        if a != b and 0.8 <= jaccard(a, b) <= 0.9:
            out.append((a, b))
    return out


@pytest.mark.parametrize("name", sorted(CLASSES))
def test_recall_at_the_threshold(spark, name):
    found = pairs(random.Random(name), *CLASSES[name], 400)
    rows = [(2 * k + i, line) for k, p in enumerate(found) for i, line in enumerate(p)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    lost = {r.doc_id for r in out.filter("n_lost > 0").collect()}
    assert lost <= {2 * k + 1 for k in range(400)}  # the later line of a pair, no other
    print(f"recall of {name} lines at 0.8 to 0.9: {len(lost) / 400:.4f}")
    assert len(lost) >= 0.985 * 400


def test_a_common_passage_makes_no_pairs(spark, monkeypatch):
    """Lines of one long passage and own words, too many to link, meet in
    bands; few of their pairs are verified, and no link among them is lost."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    passage = " ".join(word() for _ in range(45))
    lines = [" ".join(word() for _ in range(12)) + " " + passage for _ in range(150)]
    lines += [line[:30] + "0123" + line[34:] for line in lines[:20]]  # near copies of the first lines
    jaccards = {(i, j): jaccard(lines[i], lines[j]) for i in range(len(lines)) for j in range(i)}
    assert max(v for (i, j), v in jaccards.items() if i - j != 150) < 0.8 <= min(jaccards[150 + j, j] for j in range(20))
    seen, verified = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, *rest: seen.append(pairs.count()) or verified(pairs, *rest))
    out = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4))
    assert {r.doc_id for r in out.filter("n_lost > 0").collect()} == set(range(150, 170))
    assert sum(seen) < 3000  # of 14,365


def test_near_misses_are_not_verified_pair_by_pair(spark, monkeypatch):
    """Variants of one line, most of them too far apart to link, in buckets of
    all sizes: the lines of brute force go, and few more pairs than link are
    verified."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    base, lines = [word() for _ in range(80)], []
    for k in range(160):
        changed = set(rng.sample(range(80), 2 if k % 10 == 0 else 5))
        lines.append(" ".join(word() if i in changed else w for i, w in enumerate(base)))
    linked = {(i, j): jaccard(lines[i], lines[j]) >= 0.8 for i in range(len(lines)) for j in range(i)}
    least = list(range(len(lines)))
    for _ in lines:
        for (i, j), link in linked.items():
            if link:
                least[i] = least[j] = min(least[i], least[j])
    assert 5 < len(set(least)) < 155 and sum(linked.values()) < 0.1 * len(linked)
    seen, verified = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, *rest: seen.append(pairs.count()) or verified(pairs, *rest))
    monkeypatch.setattr(line_dedup, "CELL", 32)
    out = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4))
    assert {r.doc_id for r in out.filter("n_lost > 0").collect()} == {i for i, m in enumerate(least) if m < i}
    assert len(seen) == 2 and seen[1] < 0.2 * len(linked)


def test_lines_are_read_once_and_components_are_joined_by_label(spark, monkeypatch):
    """The second step takes the texts of the first, and its links join the
    first step's components, not their lines."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    base, lines = [word() for _ in range(80)], []
    for k in range(120):
        changed = set(rng.sample(range(80), 2 if k % 10 == 0 else 5))
        lines.append(" ".join(word() if i in changed else w for i, w in enumerate(base)))
    reads, sizes, read, join = [], [], line_dedup.line_texts, line_dedup.components
    monkeypatch.setattr(line_dedup, "line_texts", lambda *a: reads.append(1) or read(*a))
    monkeypatch.setattr(line_dedup, "components", lambda links: sizes.append(links.count()) or join(links))
    out = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4))
    least = list(range(len(lines)))
    linked = [(i, j) for i in range(len(lines)) for j in range(i) if jaccard(lines[i], lines[j]) >= 0.8]
    for _ in lines:
        for i, j in linked:
            least[i] = least[j] = min(least[i], least[j])
    assert {r.doc_id for r in out.filter("n_lost > 0").collect()} == {i for i, m in enumerate(least) if m < i}
    assert len(reads) == 1 and len(sizes) == 2 and sizes[0] + sizes[1] <= len(linked)


def test_new_links_join_old_components(spark):
    links = lambda rows: spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in rows], "a binary, b binary")
    labels = line_dedup.components(links([(9, 3), (3, 7), (20, 21)]))
    got = {r.node[0]: r.label[0] for r in line_dedup.relabelled(labels, links([(7, 21), (30, 31), (31, 20), (40, 41)])).collect()}
    assert got == {**dict.fromkeys((3, 7, 9, 20, 21, 30, 31), 3), 40: 40, 41: 40}


def test_settled_links_take_no_round(spark, monkeypatch):
    """Stars are written once and read off; a path takes rounds, each at most once more than needed."""
    written, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.append(name) or write(df, name))
    star = spark.createDataFrame([(1, k) for k in range(2, 9)] + [(11, 10), (12, 12)], "a long, b long")
    assert {tuple(r) for r in graph.components(star).collect()} == {(k, 1) for k in range(1, 9)} | {(10, 10), (11, 10)}
    assert written == ["links", "components"]
    path = spark.createDataFrame([(k + 1, k) for k in range(1, 60)], "a long, b long")
    assert {tuple(r) for r in graph.components(path).collect()} == {(k, 1) for k in range(1, 61)}
