"""Exact search, token alignment and the Merkle manifest against brute force and odd input."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinweave.llm import alignment, merkle, search

FOLDER = "/opt/tokenizers"
DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


# ---------------------------------------------------------------- search


def brute_search(rows, asks, k=5):
    usable = [
        (tag, i, [math.floor(256 * x) for x in v])
        for tag, (i, v) in enumerate(rows)
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for tag, i, v in usable:
        if i is not None and asks(i):
            scores = [(sum(x * y for x, y in zip(v, w)), j) for other, j, w in usable if other != tag]  # noqa: B905
            scores = [(min(max(s, -(1 << 63)), (1 << 63) - 1), j) for s, j in scores]
            scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
            out += [(i, rank + 1, j, s) for rank, (s, j) in enumerate(scores[:k])]
    return sorted(out, key=str)


def searched(spark, rows, kind="DOUBLE", k=5):
    df = spark.createDataFrame(rows, f"vec_id BIGINT, embedding ARRAY<{kind}>")
    clash = df.withColumns({c: F.lit("?") for c in ("tag", "id", "block", "part", "x", "rank", "score", "asks")})
    found = search.top_k(clash, F.col("vec_id") % 3 == 0, k)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def vectors(seed, n, dim=9):
    draw = random.Random(seed)
    some = [[draw.choice([0.0, 0.0, draw.uniform(-1, 1)]) for _ in range(dim)] for _ in range(n // 3)]
    return [(i, draw.choice(some)) for i in draw.sample(range(3 * n), n)]


def test_search_is_exact_with_ties_repeats_and_odd_vectors(spark, monkeypatch):
    rows = vectors(1, 90) + [
        (3, [0.5] * 9), (3, [0.5] * 9), (6, [0.5] * 4), (9, []), (12, None), (15, [1.0, None]), (18, [math.nan]),
        (21, [math.inf]), (None, [0.9] * 9), (None, [0.9] * 9), (24, [-0.001]), (27, [1e300, 1.0]), (28, [-1e300]),
    ]
    wanted = brute_search(rows, lambda i: i % 3 == 0)
    assert searched(spark, rows) == wanted
    monkeypatch.setattr(search, "BLOCK", 8)
    monkeypatch.setattr(search, "PART", 5)
    monkeypatch.setattr(search, "AT_A_TIME", 2)
    assert searched(spark, rows) == wanted


def test_search_with_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, -0.5]), (3, [0.0, 1.0])]
    assert searched(spark, rows, "FLOAT") == brute_search(rows, lambda i: i % 3 == 0)
    assert searched(spark, rows[:1]) == []
    assert searched(spark, []) == []


def test_block_keeps_the_earlier_of_equal_scores():
    entries = (np.arange(40), np.zeros(40, int), np.full(40, 7))
    query, row, score = search.best_of_block(
        search._postings(*entries), 40, np.array([1, -1]), (np.array([0, 1]), np.array([0, 0]), np.array([2, -3])), 2, 3
    )
    assert sorted(zip(query, row, score, strict=True)) == [(0, 0, 14), (0, 2, 14), (0, 3, 14), (1, 0, -21), (1, 1, -21), (1, 2, -21)]


# ---------------------------------------------------------------- alignment


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{FOLDER}/{alignment.A_FILE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/{alignment.B_FILE}")


def brute_groups(libraries, text):
    a, b = libraries
    if not text:
        return []
    alphabet = alignment.byte_alphabet()
    ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode([text])[0]
    raw_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [
        bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]
    ]
    if not b"".join(raw_a) == b"".join(raw_b) == f" {text}".encode():
        return []
    ends = [np.cumsum([len(t) for t in raw]) for raw in (raw_a, raw_b)]
    cuts = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
    out, before = [], 0
    for cut in cuts:
        pick = lambda ids, e: [ids[i] for i in np.flatnonzero((e > before) & (e <= cut))]  # noqa: B023, E731
        out.append((pick(ids_a, ends[0]), pick(ids_b, ends[1])))
        before = cut
    return out


def brute_alignment(libraries, rows):
    per, count, top = [], Counter(), {}
    for i, text in rows:
        groups = brute_groups(libraries, text)
        links = Counter((x, y) for a, b in groups for x in a for y in b)
        per.append((i, groups, links))
        count.update(links.keys())
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for i, groups, links in per:
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()),
            sum(n for p, n in links.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in links.items()),
            hashlib.sha256(said.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


def odd_texts():
    draw = random.Random(4)
    letters = "abcde éßñ中文ا😀́​\t\n  0123'"
    words = ["the", "unbelievable", "tokenization", "naïve", "Straße", "2024", "don't", "<|endoftext|>", "<s>"]
    mixed = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 80))) for _ in range(40)]
    said = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 60))) for _ in range(40)]
    return [None, "", " ", "\n\t", "x", "a\0b", "a▁b", "▁", " lead", "trail ", " " * 900 + "x", "z" * 3000, *mixed, *said]


@pytest.mark.parametrize("lot", [1 << 24, 300])
def test_alignment_equals_brute_force(spark, libraries, monkeypatch, lot):
    monkeypatch.setattr(alignment, "LOT", lot)
    rows = [(i, t) for i, t in enumerate(odd_texts())]
    rows += [(1, "the same id"), (None, "the unbelievable naïve"), (None, None), rows[60], rows[60]]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    clash = df.withColumns({c: F.lit(1) for c in ("lot", "pairs", "places", "n", "best", "n_a", "in_lot")})
    found = sorted((tuple(r) for r in alignment.alignment_report(clash).collect()), key=str)
    assert found == brute_alignment(libraries, rows)


def test_rank_encoder_has_the_ids_of_the_file(libraries):
    a = alignment.ByteLevel(FOLDER)
    texts = [f" {t}" for t in odd_texts() if t]
    assert a.encode(texts) == [libraries[0].encode(t, add_special_tokens=False).ids for t in texts]


def test_alignment_of_nothing(spark):
    df = spark.createDataFrame([], DOCS)
    assert alignment.alignment_report(df).count() == 0
    df = spark.createDataFrame([(1, None, None, None, None)], DOCS)
    assert [tuple(r) for r in alignment.alignment_report(df).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_leaf_groups_on_random_cuts():
    draw = np.random.default_rng(2)
    for _ in range(200):
        rows = []
        for _ in range(draw.integers(1, 5)):
            n = draw.integers(1, 60)
            some = [np.append(np.flatnonzero(draw.random(n - 1) < p) + 1, n) for p in draw.uniform(0, 1, 2)]
            rows.append(some)
        base = np.cumsum([0] + [int(a[-1]) for a, _ in rows])
        a, b = (np.concatenate([r[k] + at for r, at in zip(rows, base, strict=False)]) for k in (0, 1))
        first = [np.cumsum([0] + [len(r[k]) for r in rows]) for k in (0, 1)]
        ga, gb = alignment.leaf_groups(a, b, *first)
        shared = np.intersect1d(a, b)
        assert (a[ga - 1] == shared).all() and (b[gb - 1] == shared).all()


def test_wide_groups_are_counted_by_distinct_ids(monkeypatch):
    aligner = alignment.Aligner(FOLDER)
    texts = ["z" * 700, "unbelievable tokenization", None, "naïve 😀😀"]
    usual = aligner.align(texts)
    monkeypatch.setattr(alignment, "WIDE_GROUP", 1)
    wide = aligner.align(texts)
    for name in ("pair", "times", "upto", "n_links"):
        assert (usual[name] == wide[name]).all()


# ---------------------------------------------------------------- manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def brute_manifest(rows):
    """Rows are ``doc_id, text, lang, source, n_chars``."""
    leaf = lambda i, t, lang, s, n: digest("".join(map(encoded, (i, s, lang, n, t))))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = levels([x[2] for x in groups[g]])
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for place, g in enumerate(names):
        for at, (_, _, own, (i, t, lang, s, n)) in enumerate(groups[g]):
            bad = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
            now, proof = leaf(i, t, lang, s, n + 1) if bad else own, []
            for tree, k in ((trees[g], at), (top, place)):
                for level in tree[:-1]:
                    run = list(level[k & ~1 : (k & ~1) + 2])
                    proof += [x for j, x in enumerate(run) if j != k & 1]
                    run[k & 1] = now
                    now, k = digest("".join(run)), k >> 1
            out.append((i, own, trees[g][-1][0], top[-1][0], digest("".join(proof)), now, now == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(seed, n):
    draw = random.Random(seed)
    langs = ["en"] * 6 + ["de", "", None, "ünicode"]
    rows = [(i, draw.choice(["a:b", "-", "é" * draw.randint(0, 9), None]), draw.choice(langs), draw.choice(["s", None]), draw.choice([i, None, -1])) for i in range(n)]
    rows += [rows[3], rows[3], (None, "x", "en", None, 5), (None, "x", "en", None, 5), (4, "other", "en", "s", 1), (77, "alone", "xx", "s", (1 << 63) - 1)]
    return rows


@pytest.mark.parametrize(("n", "height"), [(60, 12), (200, 3)])
def test_manifest_equals_brute_force(spark, monkeypatch, n, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rows = manifest_rows(n, n)
    clash = spark.createDataFrame(rows, DOCS).withColumns(
        {c: F.lit("?") for c in ("tree", "leaf", "index", "size", "start", "root", "siblings", "_tie", "_part", "hash")}
    )
    found = sorted((tuple(r) for r in merkle.manifest_report(clash).collect()), key=str)
    assert found == brute_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark):
    rows = [(7, None, None, None, None)]
    found = [tuple(r) for r in merkle.manifest_report(spark.createDataFrame(rows, DOCS)).collect()]
    assert found == brute_manifest(rows)
    assert merkle.manifest_report(spark.createDataFrame([], DOCS)).count() == 0


def test_octopus_fetches_the_least_and_it_is_enough():
    draw = random.Random(3)
    for _ in range(300):
        size = draw.randint(1, 70)
        tree = levels([str(i) for i in range(size)])
        mine = sorted(draw.sample(range(size), draw.randint(1, size)))
        asked = merkle.missing(size, np.array(mine))
        nodes = merkle._empty(size)
        nodes[0] = {i: tree[0][i].encode() for i in mine}
        assert not any(i in nodes[0] for level, i in asked if level == 0)
        below = lambda level, i: {j for j in range(size) if j >> level == i}
        held = [below(*c) for c in asked]
        # nothing that a leaf of the partition lies below, nothing twice
        assert not set().union(*held) & set(mine) and sum(map(len, held)) == len(set().union(*held))
        for level, i in asked:
            nodes[level][i] = tree[level][i].encode()
        merkle.derive(nodes, size)
        assert nodes[-1][0] == tree[-1][0].encode()
        for i in mine:
            wanted = [level[(i >> k) ^ 1].encode() if (i >> k) ^ 1 < len(level) else None for k, level in enumerate(tree[:-1])]
            assert merkle.siblings(nodes, size, i) == wanted


# ---------------------------------------------------------------- line dedup by rounds


def test_line_families_are_settled_by_few_comparisons(spark, monkeypatch):
    """Two thousand near copies of a line, and chains whose neighbours only are similar."""
    from opinweave.llm import linedup

    draw = random.Random(6)
    base = [f"w{i}" for i in range(40)]
    lines = []
    for i in range(2000):
        words = list(base)
        words[draw.randrange(40)] = f"x{i}"
        lines.append(" ".join(words))
    chain = [" ".join(f"c{j}" for j in range(i, i + 20)) for i in range(0, 60, 2)]
    rows = [(i, "\n".join(lines[i * 20 : i * 20 + 20])) for i in range(100)] + [(200 + i, t) for i, t in enumerate(chain)]
    compared = []
    similar = linedup._similar
    monkeypatch.setattr(linedup, "_similar", lambda sets, pairs, p: (compared.append(pairs.count()), similar(sets, pairs, p))[1])
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    found = {r["doc_id"]: r["kept_lines"] for r in linedup.line_report(df).collect()}
    said = [(i, j, frozenset(t.split())) for i, text in rows for j, t in enumerate(text.split("\n"))]
    alike = lambda u, v: 100 * len(u & v) >= 80 * len(u | v)
    wanted = {i: [] for i, _ in rows}
    for n, (i, j, u) in enumerate(said):
        if not any(alike(u, v) for _, _, v in said[:n]):
            wanted[i].append(str(j))
    assert found == {i: ",".join(v) for i, v in wanted.items()}
    assert compared[0] <= 2030 and sum(compared) < 6000


def test_line_families_make_few_pairs(spark, monkeypatch):
    """Near copies of lines of 40 and 90 words: what is written on the way grows with their number, not its square."""
    from opinweave.llm import linedup

    draw = random.Random(8)
    lines = []
    for base in ([f"w{i}" for i in range(40)], [f"v{i}" for i in range(90)]):
        for _ in range(300):
            words = list(base)
            words[draw.randrange(len(base))] = f"x{draw.randrange(50)}"
            lines.append(" ".join(words))
    draw.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 10 : i * 10 + 10])) for i in range(60)]
    made, written = [], linedup.written

    def counted(df):
        out = written(df)
        made.append(out.count())
        return out

    monkeypatch.setattr(linedup, "written", counted)
    found = linedup.line_report(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    first = {kind: next(i for i, t in enumerate(lines) if kind in t) for kind in ("w1", "v1")}
    assert sum(r["n_removed"] for r in found) == 598 and {first["w1"], first["v1"]} == {
        r["doc_id"] * 10 + int(j) for r in found for j in r["kept_lines"].split(",") if j
    }
    assert max(made) <= 28 * len(lines)  # seven groups a line, four firsts in each; all pairs would be 89,700


# ---------------------------------------------------------------- pages whose words no training page has

_CINNAMON = "Bakers across Lisbon report that cinnamon has become scarce since the monsoon delayed every shipment."
_PRICES = "Prices doubled within a fortnight, and smaller shops have begun to close early on weekdays."
_RELIEF = 'Officials at <a href="/m">the ministry</a> promised <a href="/r">quick relief</a> before autumn ends.'
_GUS = "I never liked cinnamon anyway, says Gus, who owns a hardware shop."
_LAYOUTS = {
    "a paragraph with links beside a plain one": (f"<article><p>{_RELIEF}</p><p>{_PRICES}</p></article>", [_RELIEF, _PRICES]),
    "only paragraphs with links": (f"<article>{f'<p>{_RELIEF}</p>' * 4}</article>", [_RELIEF] * 4),
    "a related aside": (f'<article><p>{_CINNAMON}</p><aside class="related"><p>Kettles by noise.</p></aside><p>{_PRICES}</p></article>', [_CINNAMON, _PRICES]),
    "a plain aside": (f"<article><p>{_CINNAMON}</p><aside><p>Kettles ranked by weight.</p></aside><p>{_PRICES}</p></article>", [_CINNAMON, _PRICES]),
    "comments inside": (f'<article><p>{_CINNAMON}</p><p>{_PRICES}</p><div class="comments"><p>{_GUS}</p></div></article>', [_CINNAMON, _PRICES]),
    "an advert inside": (f'<article><p>{_CINNAMON}</p><div class="ad-slot"><p>Mattress sale.</p></div><p>{_PRICES}</p></article>', [_CINNAMON, _PRICES]),
    "a sign-up inside": (f'<article><p>{_CINNAMON}</p><div class="newsletter-signup"><p>Get our letter.</p></div><p>{_PRICES}</p></article>', [_CINNAMON, _PRICES]),
    "a list of comments after it": (f'<article><p>{_CINNAMON}</p><p>{_PRICES}</p></article><ol class="commentlist"><li>{_GUS}</li></ol>', [_CINNAMON, _PRICES]),
}


def test_layouts_of_articles():
    import re

    from opinweave.llm import html_extract

    weights, pair = html_extract.train()
    before = '<html><body><header><p>Zenith Gazette</p></header><nav><ul><li><a href="/">Start</a></li><li><a href="/b">Sport</a></li></ul></nav><main>'
    after = "</main><footer><p>Copyright 2031 Zenith Media Group. Imprint.</p></footer></body></html>"
    plain = lambda parts: " ".join(re.sub("<[^>]+>", "", p) for p in parts)
    cases = {name: (before + body + after, plain(parts)) for name, (body, parts) in _LAYOUTS.items()}
    cases["plain divs"] = (
        f'<html><body><div><div><p>{_CINNAMON}</p><p>{_PRICES}</p></div><div class="comments"><div><p>{_GUS}</p></div></div></div></body></html>',
        plain([_CINNAMON, _PRICES]),
    )
    cases["bare text"] = (_CINNAMON, _CINNAMON)
    cases["two bare words"] = ("Hello there.", "Hello there.")
    cases["bare text in a body"] = (f"<html><body>{_CINNAMON}<br>{_PRICES}</body></html>", plain([_CINNAMON, _PRICES]))
    found = html_extract.extract([html for html, _ in cases.values()], weights, pair)
    wrong = {name: said for (name, (_, wanted)), said in zip(cases.items(), found, strict=True) if said != wanted}
    assert not wrong


# ---------------------------------------------------------------- the bound of the language sample


def test_language_sample_is_bounded_without_ids_and_with_copies(spark):
    from opinweave.llm import langid

    rows = [(None, f"text number {i} of many", "en", None, 1) for i in range(3000)]
    rows += [(8, "the very same row", "de", None, 1)] * 3000 + [(8, f"eine andere {i}", "de", None, 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS).where(~langid.held_out())
    found = {r["lang"]: r["n"] for r in langid.drawn(docs, 300).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert 200 < found["en"] < 400 and 90 < found["de"] < 220
