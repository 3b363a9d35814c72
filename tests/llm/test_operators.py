"""The dealt operators against brute force on small tables with nulls, empty
texts, ties, repeated rows, empty tables and extra columns."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from civicspark.llm import chat, decontaminate, html_text, line_dedup, lm_score, ngram_join, packing, quality, token_counts, url_rules

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = "The quick brown fox jumps over the lazy dog, while nine small birds watch from the old grey wall near our house."
ROWS = [
    (1, BASE + "\nA second line with some more words in it.", "en", "a", "x"),
    (2, BASE + "\nA second line with some more words in it.", "en", "a", "x"),
    (3, BASE.replace("old", "odd") + "\n\nAnother  end.", None, "b", None),
    (4, "", "de", None, ""),
    (5, None, None, None, None),
    (6, "<s> a  b <|endoftext|> ### %%% ć é É\t \n", "fr", "b", "y"),
    (6, "<s> a  b <|endoftext|> ### %%% ć é É\t \n", "fr", "b", "y"),
    (None, "one two", "fr", "b", "y"),
    (8, " ".join(f"w{k % 50}" for k in range(6000)) + ".", "en", "a", "z"),
    (9, "Word. " * 400, "en", "a", "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(2).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def test_quality_measures(docs, none):
    got = collections.Counter((r.doc_id, r.m_n_words, r.m_word_chars, r.m_n_symbols, r.m_n_dup_lines, r.m_n_repeat_words, r.m_base_failed, r.kept) for r in quality.quality(docs, prefix="m_").collect())

    def ref(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        g = collections.Counter(zip(w, w[1:], w[2:]))
        cov = {k for i in range(len(w) - 2) if g[tuple(w[i:i + 3])] > 1 for k in range(i, i + 3)}
        ls = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)), len(cov), len(w) < 50 or 100 * len(cov) > 50 * len(w)

    assert got == collections.Counter((i, *ref(t), k) for i, t, _, _, k in ROWS)
    assert quality.quality(none, prefix="m_").count() == 0


def brute_kept(rows, min_group=quality.MIN_GROUP):
    """Of each (text, lang, source): whether it is kept, by fences in Python."""
    def measures(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        g = collections.Counter(zip(w, w[1:], w[2:]))
        cov = {k for i in range(len(w) - 2) if g[tuple(w[i:i + 3])] > 1 for k in range(i, i + 3)}
        ls = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        c = max(sum(map(len, w)), 1)
        return len(w) < 50 or 100 * len(cov) > 50 * len(w), (
            1000 * sum(x in "#*$%&|<>" for x in t or "") // c, 1000 * (len(ls) - len(set(ls))) // max(len(ls), 1), 1000 * len(cov) // max(len(w), 1), 10 * sum(map(len, w)) // max(len(w), 1))

    seen = [(*measures(t), la, so) for t, la, so in rows]

    def fence(k, fits):
        v = sorted(m[k] - m[k] % (1 << max(m[k].bit_length() - 7, 0)) for bad, m, la, so in seen if not bad and fits(la, so) and (k not in (1, 2) or m[k]))
        if not v:
            return 0, math.inf
        lo, hi = v[(len(v) * 25 + 99) // 100 - 1], v[(len(v) * 75 + 99) // 100 - 1]
        return len(v), hi + 6 * max(hi - lo, (10, 10, 10, 1)[k])

    def limit(k, la, so):
        own, lang, every = fence(k, lambda x, y: (x, y) == (la, so)), fence(k, lambda x, y: x == la), fence(k, lambda x, y: True)
        found = [f for n, f in (own, lang) if n >= min_group]
        return min(found + ([every[1]] if k < 3 or not found else []))

    limits = {(k, la, so): limit(k, la, so) for k in range(4) for la, so in {(la, so) for _, _, la, so in seen}}
    return [not bad and all(m[k] <= limits[k, la, so] for k in range(4)) for bad, m, la, so in seen], limits


def test_quality_fences(spark):
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyz")

    def text(size, sign="", copies=0):
        said = ["".join(rng.choice(letters, max(1, int(rng.normal(size, 1.5))))) + sign for _ in range(80)]
        lines = [" ".join(said[k:k + 8]) for k in range(0, 80, 8)]
        return "\n".join(lines + lines[:1] * copies)

    rows = [(text(5, copies=k % 7 == 0), "en", "plain") for k in range(240)] + [(text(9), "de", "plain") for _ in range(220)]
    rows += [(text(5, "$$" if k < 130 else ""), "en", "bad") for k in range(210)]  # mostly bad, large
    rows += [(text(5, "#"), "en", "few"), (text(5), "en", "few"), (text(9), None, None), (text(11), "de", "plain"), (text(9), "en", "plain"), (text(14), "de", "few")]
    kept, limits = brute_kept(rows)
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: r.m_kept for r in quality.quality(docs, prefix="m_").collect()}
    assert got == dict(enumerate(kept))
    assert not any(kept[460:590]) and sum(kept[:460]) > 440
    assert not kept[-2] and kept[-4] and limits[3, "de", "plain"] > limits[3, "en", "plain"]  # a long-worded text by its language's limit


def test_url_rules(spark):
    rules = [url_rules.site_rule("block", "example.org/en/1"), url_rules.site_rule("allow", "org/"), *url_rules.PATTERNS]
    urls = ["https://a.EXAMPLE.org/en/12?x", "http://example.org", "http://example.orgs/en/1", "x.org/ads/", None, "", "http://h.com/ads/1", "http://h.com/bads/1", "http://h.com/ads/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'old' as rule")
    for limit in (url_rules.BROADCAST_BYTES, 0):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.url_verdicts(pages, rules, broadcast_bytes=limit).collect()}
        assert got == {0: ("a.example.org", "/en/12", "example.org/en/1", "block"), 1: ("example.org", "", None, "allow"), 2: ("example.orgs", "/en/1", None, "allow"),
                       3: ("", "", None, "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("h.com", "/ads/1", None, "block"),
                       7: ("h.com", "/bads/1", None, "allow"), 8: ("h.com", "/ads/1", None, "block")}
    assert {r.verdict for r in url_rules.url_verdicts(pages, []).collect()} == {"allow"}


def test_token_counts(docs, none):
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.kept) for r in token_counts.token_counts(docs, path).collect())
    assert got == collections.Counter((i, len((t or "").encode()), len(sp.encode(t or "")), k) for i, t, _, _, k in ROWS)
    assert token_counts.token_counts(none, path).count() == 0
    for t in (" a  b ", "a ", "  ", "x▁y z", "\n a\n\nb  \n", "word " * 300):
        assert token_counts.Lengths(path).of([t]) == [len(sp.encode(t))]
        assert sum(token_counts.Lengths(path).of(list(token_counts.slices(t, 5)))) == len(sp.encode(t))


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([("a", " ".join(BASE.split()[2:14])), ("b", "ONE two!"), ("c", ""), ("d", None), ("e", " ".join(BASE.split()[4:18]))], "item_id string, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.report(docs, items).collect()}
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    want = set()
    for i, t, *_ in ROWS:
        w, hit, found = cut(t), set(), set()
        for item, said in (("a", " ".join(BASE.split()[2:14])), ("b", "one two"), ("e", " ".join(BASE.split()[4:18]))):
            g = cut(said)
            n = min(10, len(g))
            for k in range(len(g) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == g[k:k + n]:
                        hit |= set(range(p, p + n))
                        found.add(item)
        want.add((i, len(w), len(hit), tuple(sorted(found))))
    assert got == want and decontaminate.report(docs, items).count() == len(ROWS)
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect() if r.doc_id) == [4, 5, 6, 6, 8, 9]
    assert decontaminate.report(none, items).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == len(ROWS)


def test_chat_round_trip(spark):
    from pyspark.sql import functions as F
    odd = "<|im_end|><|im_start|>assistant <\\|x|> %0A<"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 1, "assistant", odd), (2, 5, "a\nb%25", None), (2, None, None, "first"), (None, 1, "assistant", "é<|")]
    out = chat.format_chats(chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.conv: ([tuple(t) for t in r.t], r.l) for r in out.select("conv", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("l")).collect()}
    assert got == {1: ([("user", odd), ("assistant", odd), ("assistant", odd)], odd * 2), 2: ([("", "first"), ("a\nb%25", "")], ""), None: ([("assistant", "é<|")], "é<|")}


def test_chat_trees(spark):
    nodes = [(1, 1, None, "user", "r", 0.0), (1, 2, 1, "assistant", "x", 1.0), (1, 3, 1, "assistant", "y", 2.0), (1, 4, 2, "user", "z", 5.0), (2, 1, 2, "user", "c", 0.0), (2, 2, 1, "user", "c", 0.0)]
    df = spark.createDataFrame(nodes, "conv long, node long, parent long, role string, text string, score double")
    got = [(r.conv, r.leaf, r["rank"], r.score, r.n_turns) for r in chat.format_chats(df, None).collect()]
    assert sorted(got) == [(1, 3, 2, 2.0, 2), (1, 4, 1, 6.0, 3)]


def test_html():
    assert html_text.main_text("") == "" and html_text.main_text("plain &amp; text <b") == "plain & text"
    page = ("<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>menu</a></nav><div id=header><h1>Site</h1></div><div class='cookie-notice'>We use, many, cookies</div>"
            "<div class='wrap has-sidebar'><div class=content><h1>Title &lt;1&gt;</h1><p>Para one,\n with  commas, and text.<p>Para <i>two</i><script>var a='</p>'</script></div>"
            "<div class=comments><p>Nice, post, indeed, really, very, long, comment, this, is</p></div><div class=sidebar><p>side</div></div><footer>f</footer>")
    assert html_text.main_text(page) == "Title <1>\nPara one, with commas, and text.\nPara two"


def test_html_bodies_in_forms_and_named_wrappers():
    body = "<h1>Title</h1>" + "".join(f"<p>Paragraph {k} of the text, with commas, and enough words to count.</p>" for k in range(4))
    want = "\n".join(["Title", *(f"Paragraph {k} of the text, with commas, and enough words to count." for k in range(4))])
    menu, foot = "<nav><a href=x>menu</a></nav><div class=menu><a href=y>more</a></div>", "<div class=sidebar><p>side</p></div><footer>f</footer>"
    for name in ("content header-fixed", "nav-open", "social", "related", "post comments-open"):
        assert html_text.main_text(f"<body>{menu}<div class='{name}'>{body}</div>{foot}</body>") == want, name
    assert html_text.main_text(f"<body><form action=x>{menu}<div id=page>{body}</div>{foot}</form></body>") == want
    assert html_text.main_text(f"<body><form><div class='nav-open'>{menu}{body}{foot}</div></form><p>c</p></body>") == want
    assert html_text.main_text(f"<body>{menu}<article><div class=entry-header><h1>T</h1></div>{body[14:]}</article>{foot}</body>") == "T" + want[5:]
    assert html_text.main_text(f"<body>{menu}<div class=social><a href=x>x</a></div><footer>f</footer></body>") == ""


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, None, "u"), (2, "<article><p>a</p></article>", None)], "page_id long, html string, text string")
    assert sorted(tuple(r) for r in html_text.page_texts(pages).collect()) == [(1, "", 0), (2, "a", 1)]


def brute_components(rows, sets, threshold):
    par = list(range(len(rows)))

    def top(x):
        while par[x] != x:
            x = par[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                par[max(top(i), top(j))] = min(top(i), top(j))
    return [top(k) for k in range(len(rows))]


def test_ngram_join(docs, none):
    def grams(t, k):
        w = words(t)
        return set(zip(*[w[j:] for j in range(k)])) if len(w) >= k else ({tuple(w)} if w else set())

    sets = [grams(r[1], 3) for r in ROWS]
    tops = brute_components(ROWS, sets, 90)
    want = []
    for r, s, t in zip(ROWS, sets, tops):
        ids = [x[0] for x, y in zip(ROWS, tops) if y == t and x[0] is not None]
        want.append((r[0], len(s), min(ids) if ids else None))
    got = [tuple(r) for r in ngram_join.classes(docs).collect()]
    assert collections.Counter(got) == collections.Counter(want)
    assert ngram_join.classes(none).count() == 0


def test_ngram_join_chains(spark):
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(base[k * 3:] + [f"t{j}" for j in range(k * 3)])) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = [set(zip(*[t.split()[j:] for j in range(3)])) for _, t in rows]
    tops = brute_components(rows, sets, 90)
    assert {r.doc_id: r.component_id for r in ngram_join.classes(docs).collect()} == {k: rows[t][0] for (k, _), t in zip(rows, tops)}
    tops = brute_components(rows, [set(zip(*[t.split()[j:] for j in range(5)])) for _, t in rows], 80)
    assert {r.doc_id for r in ngram_join.one_each(docs).collect()} == {rows[t][0] for t in tops}


def test_line_dedup(docs, none):
    out = line_dedup.dedup_lines(docs).collect()
    assert len(out) == len(ROWS)
    by = collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert by[1][0].text == ROWS[0][1] and by[1][0].n_lost == 0
    assert by[2][0].text == "" and by[2][0].n_lost == 2
    assert by[3][0].text == "\nAnother  end."  # its first line is like document 1's
    assert by[4][0].text == "" and by[5][0].text is None
    assert [r.text for r in by[6]] == [ROWS[5][1]] * 2  # equal rows are one place
    assert line_dedup.dedup_lines(none).count() == 0


def backoff(corpus, order):
    """Stupid-backoff score of each word sequence of ``corpus``."""
    c = collections.Counter(tuple(w[i:i + k]) for w in corpus for k in range(1, order + 1) for i in range(len(w) - k + 1))
    n = sum(map(len, corpus))

    def score(w):
        s = 0.0
        for p in range(len(w)):
            for given_up, k in enumerate(range(min(p + 1, order), 0, -1)):
                gram = tuple(w[p - k + 1:p + 1])
                if k == 1 or c[gram] >= 2:
                    s += given_up * math.log(0.4) + math.log(c[gram] / (c[gram[:-1]] if k > 1 else n))
                    break
        return len(w), round(s, 4)

    return [score(w) for w in corpus]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_scores(docs, none, order):
    got = collections.Counter((r.doc_id, r.n_words, round(r.log_score, 4)) for r in lm_score.lm_scores(docs, block_bytes=9000, order=order).collect())
    assert got == collections.Counter((r[0], *s) for r, s in zip(ROWS, backoff([words(r[1]) for r in ROWS], order)))
    assert lm_score.lm_scores(none, order=order).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scores_of_copies(spark, monkeypatch, order):
    """Copies reach Python once, count as often as they are, and are all scored."""
    monkeypatch.setattr(lm_score, "COPIES", 7)
    rows = [(None, "a b a b c")] * 50 + [(1, "a b a b c")] * 3 + [(2, "b c d a"), (3, ""), (3, ""), (4, None)]
    split = lm_score._grams

    def grams(column, order):
        assert len(column) <= 5
        return split(column, order)

    monkeypatch.setattr(lm_score, "_grams", grams)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.n_words, round(r.log_score, 4)) for r in lm_score.lm_scores(frame, order=order).collect())
    assert got == collections.Counter((i, *s) for (i, _), s in zip(rows, backoff([words(t) for _, t in rows], order)))


def test_packing(docs, none):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    out = packing.pieces(packing.pack(docs, path, window=512)).collect()
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t, *_ in ROWS}
    total = collections.Counter()
    seq = collections.defaultdict(list)
    for r in out:
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32
        total[r.doc_id] += r.length
        seq[r.sequence_id].append((r.offset, r.length))
    copies = collections.Counter(r[0] for r in ROWS)
    assert total == {i: len(x) * copies[i] for i, x in ids.items()}
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(none, path).count() == 0


def test_best_cuts_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(50):
        points = np.unique(rng.integers(1, 60, 12))
        if np.diff(np.concatenate([[0], points])).max() > 20:
            continue
        pen = rng.integers(0, 9, len(points))
        at, cost = [0, *points], [0]
        for j in range(1, len(at)):
            cost.append(min(cost[i] + 20 - (at[j] - at[i]) for i in range(j) if at[j] - at[i] <= 20) + pen[j - 1])
        cuts = packing.best_cuts(points, pen, 20, True)
        price = dict(zip(points.tolist(), pen.tolist()))
        assert sum(20 - (b - a) + price[b] for a, b in zip([0, *cuts], cuts)) == cost[-1]


def test_hard_cuts_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        total = int(rng.integers(20, 150))
        ends = np.unique(np.append(rng.integers(1, total, 3), total))
        stops = np.unique(rng.integers(1, total, 4))
        points, pen = packing.cut_points(total, ends, stops)
        price = dict.fromkeys(range(1, total + 1), 6) | {int(x): min(6, int(p)) for x, p in zip(points, pen // 4)}
        cost = [0]
        for j in range(1, total + 1):
            cost.append(min(cost[max(0, j - 20):j]) + 20 + price[j])
        cuts = packing.best_cuts(points, pen // 4, 20, True, hard=6)
        assert cuts[-1] == total and max(np.diff([0, *cuts])) <= 20
        assert sum(20 + price[c] for c in cuts) == cost[-1]
        left = packing.best_cuts(points, pen // 4, 20, False, hard=6)
        assert total - (left or [0])[-1] < 20


@pytest.mark.parametrize("length", [2100, 3000, 6000])
def test_packing_without_stops(spark, length):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(k, "word " * (length - 1)) for k in range(60)], "doc_id long, text string").coalesce(1)
    sizes = [r.n_tokens for r in packing.pack(docs, path).orderBy("sequence_id").collect()]
    ids = sum(sizes)
    assert ids >= 60 * length and max(sizes) <= 4096
    assert len(sizes) * 4096 - ids < 0.05 * len(sizes) * 4096 + 4096  # the last sequence is part-filled


def test_near_copies_without_ids(spark):
    """300 near copies with null ids, and 300 texts of one id: each node's text is read once."""
    rng = np.random.default_rng(3)
    words_ = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(300):
        w = list(words_)
        w[int(rng.integers(0, 150))] = f"x{k}"
        rows += [(None, " ".join(w)), (7, " ".join([*w[::-1], "y"]))]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    reads = []
    real = ngram_join.Verifier.sets

    def counted(self, nodes):
        out = real(self, nodes)
        reads.append((out.count(), nodes.distinct().count()))
        return out

    ngram_join.Verifier.sets = counted
    try:
        got = ngram_join.classes(docs_, size=3, threshold=90).collect()
    finally:
        ngram_join.Verifier.sets = real
    assert reads and all(n == m for n, m in reads)
    assert {(r.doc_id, r.component_id) for r in got} == {(None, None), (7, 7)} and len(got) == 600


def test_decontamination_of_repeated_rows(spark, monkeypatch):
    """Rows that repeat come back as often as they are, by parts."""
    monkeypatch.setattr(decontaminate, "COPIES", 4)
    text = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"so {text} it is")] * 9 + [(2, "clean words only")] * 4 + [(None, None)] * 5 + [(3, text)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(7, text)], "item_id long, text string")
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in decontaminate.report(docs_, items).collect())
    assert got == {(1, 14, 11, ("7",)): 9, (2, 3, 0, ()): 4, (None, 0, 0, ()): 5, (3, 11, 11, ("7",)): 1}
