"""Fill-in-the-middle, nearest neighbours and the divergence audit: odd rows and brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tariffspark.llm import divergence, fim, neighbours

SCHEMA = "doc_id long, text string, lang string, source string, fim int, __id int, __text int"
LONG = " ".join(f"w{i % 977}" for i in range(60_000)) + "  \n"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "one two  three\n"), (2, None), (3, ""), (4, " \t\n"), (5, "keep <S> plain"), (6, LONG), (7, "é ñ \U0001f600 ü"), (7, "é ñ \U0001f600 ü"), (None, "no id here"),
            (8, "<P <S P> S> <"), (9, "a\x0bb\x0cc\xa0d")] + [(i, f"alpha {i} beta\ngamma  delta{i}") for i in range(100, 160)]
    return spark.createDataFrame([(*r, "en", "s", 1, 2, 3) for r in rows], SCHEMA)


def plain_fim(doc, text):
    """The transformation by its definition, on code points."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, digest = len(units), hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"


def test_fill_in_middle_by_definition(odd):
    got = fim.fill_in_middle(odd)
    assert got.columns == [*odd.columns, "_fim"]
    rows, forms = fim.restored(got.select("doc_id", "text", "_fim.*")).collect(), set()
    assert len(rows) == odd.count()
    for r in rows:
        n, form, pre, mid, output = plain_fim(r.doc_id, r.text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (n, form, pre, mid, output), r.doc_id
        assert r.restored == (r.text or "") and r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(odd.limit(0)).count() == 0


def test_every_text_can_be_arranged(odd):
    rows = fim.restored(fim.fill_in_middle(odd, rate=100, spm_share=50).select("text", "_fim.*")).collect()
    assert all(r.restored == (r.text or "") for r in rows)
    assert {r.form for r in rows if r.text and "<S>" not in r.text} == {"psm", "spm"}


def test_piece_tables_share_their_buffer():
    text = memoryview(b"abcdefgh")
    table = fim.PieceTable([text], [(0, 0, 8)]).cut([5, 2]).cut([2, 8])
    assert [bytes(v) for v in table.views()] == [b"ab", b"", b"cde", b"fgh", b""] and all(v.obj is text.obj for v in table.views())
    assert table.arranged([3, 0, 1, 2, 4]).digest() == hashlib.sha256(b"fghabcde").hexdigest()


def vectors(spark, rows, extra=True):
    df = spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None) for i, v in rows], "vec_id long, embedding array<float>")
    return df.withColumns({c: F.lit(0) for c in ("cell", "score", "v", "query_id")}) if extra else df


def brute(rows, k):
    rows = {(i, tuple(np.float32(v).tolist())) for i, v in rows}
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            scores = sorted(((-sum(np.float64(a) * np.float64(b) for a, b in zip(v, w)), j) for j, w in rows if j != i))[:k]
            out[i] = [(j, -s) for s, j in scores]
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def recall(got, want):
    return sum(len({j for j, _ in got[q]} & {j for j, _ in w}) for q, w in want.items()) / max(1, sum(map(len, want.values())))


def test_recall_and_scores_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((25, 24))
    rows = [(i, centres[i % 25] * (1 + i % 3) + 0.3 * rng.standard_normal(24)) for i in range(1500)]
    want = brute(rows, 20)
    got = found(neighbours.nearest(vectors(spark, rows).repartition(5), F.col("vec_id") % 20 == 0, cell_rows=100, leaf_rows=16, fit_rows=300, block_rows=30))
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values()) and recall(got, want) >= 0.95
    exact = {(q, j): s for q, w in brute(rows, 1500).items() for j, s in w}
    assert all(exact[q, j] == s for q, g in got.items() for j, s in g)


def test_isotropic_vectors_keep_their_recall(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v / np.linalg.norm(v)) for i, v in enumerate(rng.standard_normal((1500, 64)))]
    want = brute(rows, 20)
    got = found(neighbours.nearest(vectors(spark, rows, False).repartition(3), F.col("vec_id") % 20 == 0, leaf_rows=32))
    assert recall(got, want) >= 0.9


def test_odd_vectors(spark):
    rng = np.random.default_rng(7)
    hot = [1.0, 2.0, -1.0]
    rows = [(i, hot) for i in range(400)] + [(i, rng.standard_normal(3)) for i in range(400, 460)] + [(420, rng.standard_normal(3))] + [(7, hot), (440, [1e-3, 0, 0])]
    junk = [(1000, None), (1020, [0.0, 0.0, 0.0]), (1040, [float("nan"), 1, 1]), (1060, [float("inf"), 0, 0]), (1080, [1.0, 2.0]), (1100, [])]
    df = vectors(spark, rows + junk).unionByName(spark.createDataFrame([(None, hot), (1120, [1.0, None, 1.0])], "vec_id long, embedding array<float>")
                                                 .withColumns({c: F.lit(0) for c in ("cell", "score", "v", "query_id")}))
    got = found(neighbours.nearest(df, F.col("vec_id") % 20 == 0, cell_rows=50, leaf_rows=8, tree_rows=64, certainty=0.999999))
    want = brute(rows, 20)
    seen = {q: sorted({*g}, key=lambda x: (-x[1], x[0])) for q, g in want.items()}
    assert got.keys() == want.keys() and [j for j, _ in got[0]] == list(range(1, 21)) and [j for j, _ in got[20]] == list(range(20))
    assert sum(got[q] == seen[q] for q in got) >= len(got) - 2  # ids 420 and 440 stand for two vectors each
    few = found(neighbours.nearest(vectors(spark, [(0, hot), (20, hot), (21, [1, 0, 0])]), F.col("vec_id") % 20 == 0))
    assert few == {0: [(20, 6.0), (21, 1.0)], 20: [(0, 6.0), (21, 1.0)]}
    assert found(neighbours.nearest(vectors(spark, [(0, hot)]), F.col("vec_id") % 20 == 0)) == {}
    assert neighbours.nearest(vectors(spark, [(1, None)]), F.col("vec_id") % 20 == 0).count() == 0


def test_quantiles_of_chi_square():
    # Fixed values from printed tables.
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.507) < 1e-3 and abs(neighbours.chi_square_quantile(0.5, 2) - 1.3863) < 1e-4


def plain_audit(docs, top):
    """The audit by its definition, over all terms of all pairs."""
    count, held, seen, groups = defaultdict(Counter), Counter(), defaultdict(set), set()
    for n, (_, text, lang, source, *_) in enumerate(docs):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            count[lang, source][term] += 1
            seen[lang, term].add(n)
    kept = defaultdict(list)
    for (lang, term), d in seen.items():
        if len(d) >= 3:
            kept[lang].append(term)
            held[lang, term] = sum(c[term] for (la, _), c in count.items() if la == lang)
    out = set()
    for lang, source in groups:
        terms = kept[lang]
        v = len(terms)
        share = lambda c, total: 1 + 10 ** 9 * (c + 1) // (total + v)
        total = {g: sum(count[g][t] for t in terms) for g in groups if g[0] == lang}
        p = {g: {t: share(count[g][t], n) for t in terms} for g, n in total.items()}
        whole = sum(held[lang, t] for t in terms)
        mine = p[lang, source]
        chi = lambda a, b: (a - b) ** 2 // b
        pairs = [(-sum(chi(mine[t], p[g][t]) for t in terms), g[1]) for g in total if g[1] != source]
        above = [(-chi(mine[t], share(held[lang, t], whole)), t) for t in terms if count[lang, source][t] and mine[t] > share(held[lang, t], whole)]
        for part, rows in (("pair", sorted(pairs, key=lambda r: (r[0], r[1].encode()))), ("term", sorted(above, key=lambda r: (r[0], r[1].encode()))[:top])):
            out |= {(lang, source, part, item, -value, i + 1) for i, (value, item) in enumerate(rows)}
    return out


def test_audit_by_definition(spark):
    draw = random.Random(3)
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "xyz"] + ["Été", "ÉTÉ", "naïve", "\U0001f600", "日本"]
    docs = [(i, " ".join(draw.choices(words, k=draw.randrange(0, 40))) + ",tail-Tail", draw.choice(["en", "de", None]), draw.choice(["a", "b", "c", None, "hot", "hot", "hot"]), 0, 0, 0)
            for i in range(150)]
    docs += [(900, None, "en", "mute", 0, 0, 0), (901, "", "fr", "x", 0, 0, 0), (902, "solo", "fr", "y", 0, 0, 0), (None, "odd-row", None, None, 0, 0, 0), (903, LONG, "en", "long", 0, 0, 0)]
    docs += [docs[0]] * 2
    df = spark.createDataFrame(docs, SCHEMA).repartition(6)
    want = plain_audit(docs, 5)
    for settings in ({}, {"block_postings": 20, "page_postings": 3}):
        rows = divergence.audit(df, top_terms=5, **settings).collect()
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert divergence.audit(df.limit(0)).count() == 0
