"""The training-data operators against brute force, round trips and odd input."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opinweave.llm import (
    chat, decontam, factors, graph, html_extract, langid, linedup, mixing, neardup, quality, repeats, sharding,
    shingling,
)

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, DOCS + extra)


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text))


def odd(extra=()):
    """Null and blank texts, null ids, ties, repeated rows, null labels."""
    long = " ".join(f"w{i % 97}x{i % 89}" for i in range(30_000))
    rows = [
        doc(1, None), doc(2, ""), doc(3, " \n\t\n "), doc(None, "a lone text without any id at all"), doc(None, None),
        doc(4, "word"), doc(5, "Zwölf Boxkämpfer jagen Viktor", None, None), doc(6, long), doc(6, long), doc(7, long),
        doc(8, "x" * 5000), doc(9, "\n".join(["same line here"] * 40)), doc(9, "another text with id nine"),
    ]
    return [r + tuple(extra) for r in rows]


def texts(seed, n=60):
    """Random texts with copies, near copies and shared passages."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 6))) for _ in range(300)]
    passage = " ".join(draw.choice(words) for _ in range(60))
    out = []
    for i in range(n):
        kind = draw.random()
        if kind < 0.15 and out:
            out.append(draw.choice(out))
        elif kind < 0.45 and out:
            w = draw.choice(out).split(" ")
            for _ in range(draw.randint(1, 6)):
                w[draw.randrange(len(w))] = draw.choice(words)
            out.append(" ".join(w))
        else:
            w = [draw.choice(words) + draw.choice(["", "", "\n"]) for _ in range(draw.randint(1, 200))]
            if kind > 0.85:
                w.insert(draw.randrange(len(w)), passage)
            out.append(" ".join(w))
    return out


# ---------------------------------------------------------------- decontamination


def item_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def brute_contamination(rows, items):
    windows = {}
    for item, text in items:
        w = item_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    out = []
    for i, text in rows:
        w, hit, found = item_words(text), set(), set()
        for win, ids in windows.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def test_contamination_is_exact(spark):
    draw = random.Random(5)
    vocabulary = ["ab", "CD", "e1", "été", "x", "yy"]
    say = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, say(draw.randint(0, 14))) for i in range(8)] + [(None, say(12)), (3, None), (4, "...")]
    rows = [(i, say(draw.randint(0, 40))) for i in range(20)]
    rows += [(30 + i, f"{say(5)} -- {t}! {say(5)}") for i, (_, t) in enumerate(items) if t]
    rows += [(1, None), (None, items[0][1]), (1, say(20)), (2, rows[2][1])]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("w", F.lit(1))
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING").withColumn("n", F.lit(1))
    found = sorted((tuple(r) for r in decontam.contamination_report(docs, bench).collect()), key=str)
    assert found == brute_contamination(rows, items)
    clean = decontam.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not r[-1] for r in found)


def test_contamination_without_items_or_documents(spark):
    docs = frame(spark, odd())
    none = spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert {r["contaminated"] for r in decontam.contamination_report(docs, none).collect()} == {False}
    assert decontam.contamination_report(docs.limit(0), none).count() == 0


def test_shuffled_item_side_gives_the_same(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts(3, 20))]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    bench = spark.createDataFrame([(i, t[:150]) for i, t in rows[:5]], "item_id BIGINT, text STRING")
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 1)
    found = sorted((tuple(r) for r in decontam.contamination_report(docs, bench).collect()), key=str)
    assert found == brute_contamination(rows, [(i, t[:150]) for i, t in rows[:5]])


# ---------------------------------------------------------------- near duplicates


def brute_groups(rows, k, percent):
    def shingles(text):
        w = (text or "").encode().lower().split()
        if len(w) < k:
            return {tuple(w)} if w else set()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicate_groups_are_exact(spark, seed):
    rows = list(enumerate(texts(seed, 120)))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    found = sorted(tuple(r) for r in neardup.group_report(docs).collect())
    assert found == brute_groups(rows, 3, 85)


def test_large_regions_are_compared_in_blocks(spark, monkeypatch):
    draw = random.Random(9)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(draw.randint(0, 9)):
            w[draw.randrange(len(w))] = f"v{draw.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(neardup, "REGION", 4)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert sorted(tuple(r) for r in neardup.group_report(docs).collect()) == brute_groups(rows, 3, 85)


def test_pairs_that_part_in_large_regions_are_linked(spark, monkeypatch):
    draw, rows = random.Random(3), []
    powers = shingling.Powers()
    while len(rows) < 8:  # near the threshold, and alike at the deepest level in no tree
        w = [f"w{draw.randrange(10**9)}" for _ in range(102)]
        pair = [" ".join(w), " ".join([*w[:90], *(f"v{draw.randrange(10**9)}" for _ in range(8))])]
        sets = shingling.shingles(*shingling.word_hashes(pa.array(pair), powers), 3)
        x, y = shingling.minhash(sets, neardup.MULTIPLIERS).reshape(2, neardup.TREES, neardup.DEEPEST)
        if (x[:, :3] == y[:, :3]).all(1).any() and not (x == y).all(1).any():
            rows += [(len(rows) + i, t) for i, t in enumerate(pair)]
    monkeypatch.setattr(neardup, "REGION", 1)
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    found = {r["doc_id"]: r["component_id"] for r in neardup.group_report(docs, 3, 80).collect()}
    assert found == {i: i - i % 2 for i in range(8)}


def test_near_duplicates_of_odd_rows(spark):
    docs = frame(spark, odd(extra=(1,)), ", node INT")
    rows = neardup.groups(docs, 3, 85).collect()
    assert len(rows) == docs.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    assert by_id[1] == {(0, 1)} and by_id[3] == {(0, 3)} and by_id[4] == {(1, 4)}
    assert {c for _, c in by_id[7]} == {6}
    kept = neardup.one_of_each(docs, 3, 85)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()).count(7) == 0
    assert neardup.groups(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [doc(None, a), doc(None, b), doc(None, b + " end"), doc(6, c), doc(6, c), doc(7, c)]
    rows += [doc(None, None), doc(None, None), doc(8, "")]
    kept = sorted(neardup.one_of_each(frame(spark, rows), 3, 85).collect(), key=str)
    texts = [(r["doc_id"], r["text"]) for r in kept]
    assert len(kept) == 6 and texts.count((None, a)) == texts.count((6, c)) == texts.count((8, "")) == 1
    assert texts.count((None, b)) + texts.count((None, b + " end")) == 1 and texts.count((None, None)) == 2


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    found = graph.components(spark.createDataFrame(links, "a BIGINT, b BIGINT")).collect()
    roots = {r["node"]: r["root"] for r in found}
    assert {roots[i] for i in range(41)} == {0}
    assert {roots[i] for i in range(100, 140)} == {100}
    assert roots[200] == roots[201] == 200 and len(found) == len(roots)


# ---------------------------------------------------------------- repeated bytes


def brute_repeats(rows, span):
    seen, out = set(), []
    for i, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - span + 1):
            if b[s : s + span] in seen:
                gone[s : s + span] = True
            seen.add(b[s : s + span])
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("span", "gram"), [(100, 32), (20, 8), (12, 12)])
def test_repeated_bytes_are_exact(spark, span, gram):
    rows = list(enumerate(texts(4, 50)))
    rows += [(100, "ab" * 400), (101, "x" * 300), (102, None), (103, ""), (104, "é" * 100), (105, "\x00" * 150)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    found = repeats.repeat_report(docs, span=span, gram=gram).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == brute_repeats(rows, span)


def test_repeated_bytes_of_odd_rows(spark):
    docs = frame(spark, odd(extra=(0,)), ", kept INT")
    rows = repeats.remove_repeats(docs).collect()
    assert len(rows) == docs.count()
    assert {r["n_removed"] for r in rows if r["doc_id"] == 7} == {len(odd()[7][1])}
    assert {r["n_removed"] for r in rows if not (r["text"] or "").strip()} == {0}
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_passages_spliced_around_a_frequent_anchor(spark):
    draw = np.random.default_rng(5)

    def letters(n):
        return draw.integers(97, 123, n).astype(np.uint8).tobytes().decode()

    many = letters(200_000)
    at = int(np.argmin(factors._gram_hashes(np.frombuffer(many.encode(), np.uint8), 32)))
    gram, rows, last = many[at : at + 32], [], []
    for i in range(30):  # of C only the first and the last window are in A and B
        left, right = letters(68), letters(68)
        rows += [(i, left + gram + letters(90)), (100 + i, letters(90) + gram + right), (200 + i, left + gram + right)]
        last += ["|", left[34:] + gram + right[:34], "|", letters(150)]
    rows.append((1000, "".join(last) + letters(5 << 20)))  # over 4 MB: a batch of its own
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = {r["doc_id"]: r for r in repeats.repeat_report(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (found[1000]["n_removed"], found[1000]["n_spans"]) == (3000, 30)
    assert all(found[200 + i]["n_removed"] == 168 and found[i]["n_removed"] == 0 for i in range(30))


def test_factor_helpers():
    rank = np.array([3, 1, 2, 0, 5, 4, 4])
    run = np.array([0, 0, 0, 0, 1, 1, 2])
    before, behind = factors.smaller_neighbours(rank, run)
    assert before.tolist() == [-1, -1, 1, -1, -1, -1, -1]
    assert behind.tolist() == [1, 3, 3, -1, 5, -1, -1]
    raw = np.random.default_rng(0).integers(97, 100, 500).astype(np.uint8)
    offsets = np.array([0, 180, 180, 190, 500])
    _, place, first, last = factors.anchors(raw, offsets, 30, 8)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    assert sorted(starts.tolist()) == [*range(0, 151), *range(190, 471)]
    assert ((place >= last) & (place + 8 <= first + 30)).all()


# ---------------------------------------------------------------- pages


def test_extraction_of_other_layouts():
    weights, pair = html_extract.train()
    say = "The harbour was quiet that morning, and only two boats went out before the rain came."
    page = (
        '<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>'
        '<header><a href="/">Home</a><p>The daily harbour</p></header><div class="menu"><a href="/x">News</a></div>'
        f"<article><h1>Quiet &amp; grey</h1><p>{say}<p>Second  <b>para</b>graph&nbsp;here<br>and {say}</p>"
        '<div class="advert">Buy now, buy cheap</div></article>'
        '<aside class="sidebar"><p>Most read today</p></aside><section class="comments"><h3>Comments</h3>'
        "<p>I was there and it rained a lot.</p></section><form><label>Name</label></form><footer>All rights</footer>"
    )
    plain = f"<p>{say}</p>"
    found = html_extract.extract([page, "", plain, "a < b"], weights, pair)
    assert found[0] == f"Quiet & grey {say} Second paragraph here and {say}"
    assert found[1] == ""
    assert len(found) == 4


def test_unclosed_silent_elements_end_and_formulas_stay():
    def seen(html):
        page = html_extract.Page(html)
        return page.text(np.ones(len(page.tag), bool))

    choices = "<datalist><option value=a><option value=b>B</datalist>"
    assert seen(f"<div>{choices}<article><p>one</p></article></div>two") == "one two"
    assert seen("<div><option>A<option>B<p>one</p>two</div>") == "one two"
    assert seen("<div><option>A</div><p>one</p>") == "one"
    assert seen("<div><select><optgroup><option>A<option>B</optgroup></select>one</div>") == "one"
    assert seen("<div><select><option>A<select>one</div>") == "one"
    for tag in ("svg", "canvas", "object", "noscript", "template", "select"):
        assert seen(f"<main><div><{tag}><b>no</b></div><p>one</p></main>") == "one"
        assert seen(f"<div><{tag}><{tag}2>no</{tag}2></p></span>no</{tag}>one</div>") == "one"
    assert seen("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then</p>") == "if x=1 then"


def test_messages_give_exact_marginals():
    page = html_extract.Page("<div><p>one two</p><ul class=menu><li>three<li>four</ul></div><main>five</main>")
    forest = html_extract.Forest([page])
    draw = np.random.default_rng(1)
    weights, pair = draw.normal(size=html_extract.N_FEATURES), draw.normal(size=(html_extract.KINDS, 2, 2))
    kind = page.kinds()
    single, pairs, log_z = forest.marginals(weights, pair)
    n, total = len(page.tag), 0.0
    expect, expect_pair = np.zeros(n), np.zeros((n, 2, 2))
    for state in itertools.product([0, 1], repeat=n):
        s = np.array(state)
        value = np.exp((forest.features @ weights) @ s + sum(pair[kind[i], s[page.parent[i]], s[i]] for i in range(1, n)))
        total += value
        expect += value * s
        for i in range(1, n):
            expect_pair[i, s[page.parent[i]], s[i]] += value
    assert np.allclose(single[:, 1], expect / total) and np.isclose(log_z, np.log(total))
    assert np.allclose(pairs[1:], (expect_pair / total)[1:])


def test_pages_with_odd_rows(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, "u", None, 5), (2, None, "", 5), (None, "v", deep, 5), (3, "w", "</p></div><<>&#xZZ;<p", 5)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, n_chars INT")
    found = html_extract.extract_pages(pages).collect()
    assert len(found) == 4 and all(r["n_chars"] == len(r["text"]) for r in found)
    assert [r["text"] for r in found if r["page_id"] in (1, 2)] == ["", ""]
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_articles_of_the_pages_table(spark, sf):
    import html

    rows = spark.read.parquet(f"{sf}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in html_extract.extract_pages(rows).collect()}
    same = 0
    for r in rows.collect():
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        bare = re.sub("</?(?:p|br|h1)>", " ", re.sub("</?b>", "", article))
        same += found[r["page_id"]] == " ".join(html.unescape(bare).split())
    assert same >= 0.99 * len(found)


# ---------------------------------------------------------------- quality


def brute_base(text):
    w = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    spans, covered = {}, set()
    for i in range(len(w) - 7):
        spans.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in spans.values():
        if len(at) > 1:
            covered |= {i + j for i in at for j in range(8)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    chars = sum(len(x.decode()) for x in w)
    return [len(w), chars, symbols, len(lines) - len(set(lines)), len(covered)]


def test_base_counts_are_exact():
    rows = [*texts(8, 40), "", None, " \n ", "é ü ## <a>", "a b c d e f g h " * 3, "one\none\n\n two \n two ", " x y z"]
    base, features = quality.statistics(pa.array(rows, pa.string()).fill_null(""))
    assert base.tolist() == [brute_base(t) for t in rows]
    assert np.isfinite(features).all() and features.shape[1] == len(quality.FEATURES)


def test_trees_are_monotonic_and_flat_scores_match_a_walk():
    draw = np.random.default_rng(3)
    x = draw.random((800, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * draw.normal(size=800) > 0).astype(float)
    trees = quality.boost(x, y, monotone=[1, -1, 0])
    p = trees.score(x)
    assert ((p > 0.5) == (y == 1)).mean() > 0.85
    for j, sign in ((0, 1), (1, -1)):
        for row in x[:20]:
            line = np.tile(row, (50, 1))
            line[:, j] = np.linspace(0, 1, 50)
            assert (sign * np.diff(trees.score(line)) >= -1e-12).all()
    for row in x[:10]:
        total = trees.start
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        assert np.isclose(trees.score(row[None])[0], 1 / (1 + np.exp(-total)))


def test_quality_of_odd_rows_and_without_labels(spark):
    docs = frame(spark, odd(extra=(1,)), ", kept INT")
    labels = spark.createDataFrame([(1, 1), (None, 0), (4, None)], "doc_id BIGINT, quality INT")
    rows = quality.quality_report(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 20)
    assert quality.quality_report(docs.limit(0), labels.limit(0)).count() == 0


def test_quality_holds_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learn = labels.where("doc_id % 2 = 0")
    found = quality.score(docs.select("doc_id", "text"), quality.train(docs, learn)).join(labels, "doc_id")
    found = found.where("doc_id % 2 = 1 and not base_failed")
    right = found.select(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.97


# ---------------------------------------------------------------- language


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(["a", "b", "ab", "ba", "aba", langid.MARK + "a", langid.MARK])
    chances = np.random.default_rng(2).random((8, 2)) / 4 + 0.01
    chances[-1] = 0
    names = {p: i for i, p in enumerate(["a", "b", "ab", "ba", "aba", langid.MARK + "a", langid.MARK])}

    def total(word, j):
        if not word:
            return 1.0
        out = 0.0
        for n in range(1, len(word) + 1):
            p = chances[names[word[:n]], j] if word[:n] in names else 0.0
            out += (max(p, langid.CHAR_FLOOR) if n == 1 else p) * total(word[n:], j)
        return out

    for word in ("ab", "abab", "bbac", "a"):
        marked = langid.MARK + word
        got = langid._forward(pieces.lattice([marked]), len(marked), chances)[-1][0]
        assert np.allclose(got, [total(marked, 0), total(marked, 1)])


def test_language_is_right_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    rows = odd(extra=(1,)) + [doc(20, "123 ²½ !!") + (1,), doc(21, "漢" * 3000) + (1,), doc(22, "Ünï" * 500) + (1,)]
    docs = frame(spark, rows, ", score INT")
    model = langid.train(docs)
    found = langid.predict(docs, model).collect()
    assert len(found) == len(rows)
    blank = [r for r in found if not any(c.isalpha() for c in r["text"] or "")]
    assert {r["lang_pred"] for r in blank} == {"und"} and {r["score"] for r in blank} == {0.0}
    assert {r["lang_pred"] for r in found if r not in blank} == {"en"}
    none = langid.train(docs.where("lang is null"))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}


# ---------------------------------------------------------------- mixing


def test_targets_share_the_excess():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 1.5, 2.0) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([0, 10], [1, 1], 1.5, 2.0) == [0.0, 15.0]
    assert mixing.targets([], [], 1.5, 2.0) == []


def test_splitting_tree_is_exact():
    quotas = np.array([1000, 37, 0, 512])
    shares = mixing.split_quotas(quotas, 7, seed=3)
    assert (shares.sum(1) == quotas).all() and np.ptp(shares.sum(0)) <= 3
    assert (shares == mixing.split_quotas(quotas, 7, seed=3)).all()


def test_mix_takes_the_targets(spark):
    draw = random.Random(2)
    rows = [doc(i, " ".join(["w"] * draw.randint(0, 30)), source=draw.choice(["b", "a", "é", None])) for i in range(300)]
    docs = frame(spark, rows)
    mixed = mixing.mix(docs, n_shards=5).persist()
    report = mixing.mix_report(docs).collect()
    by_source = {}
    size_of = {r["doc_id"]: r for r in report}
    for r in rows:
        by_source.setdefault(r[3], []).append(size_of[r[0]])
    for found in by_source.values():
        assert sum(f["taken"] for f in found) == round(found[0]["target"])
        assert sum(f["size"] for f in found) == found[0]["source_size"]
    assert all(f["taken"] <= 2 * f["size"] for f in report)
    assert sum(f["target"] for f in (v[0] for v in by_source.values())) == pytest.approx(1.5 * sum(r["size"] for r in report))
    out = mixing.drawn_documents(mixed, docs.columns)
    words = sum(len(r["text"].split()) for r in out.collect())
    assert words == sum(r["taken"] for r in report)
    shards = [r["count"] for r in out.groupBy("_shard").count().collect()]
    assert len(shards) == 5 and max(shards) - min(shards) <= 3
    assert sorted(map(str, mixing.mix_report(docs.repartition(3)).collect())) == sorted(map(str, report))


def test_mix_of_odd_rows(spark, monkeypatch):
    docs = frame(spark, odd(extra=(1,)), ", size INT")
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    monkeypatch.setattr(mixing, "TREE_BLOCKS", 2)
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == docs.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix_report(docs.limit(0)).count() == 0


def test_leaves_of_the_tree_hold_every_draw_once(spark):
    """The shards against a plain walk along the seeded order of every source."""
    rows = [doc(i, "w " * (i % 9), source="ab"[i % 3 > 1]) for i in range(200)]
    docs, n_shards, seed = frame(spark, rows), 5, 7
    mixed = mixing.mix(docs, n_shards=n_shards)
    got = {}
    for r in mixed.collect():
        got.update({(r["doc_id"], d["epoch"]): (d["shard"], d["words"]) for d in r["draws"]})
    order, draws = {}, {}
    for r in mixed.select("doc_id", "text", "source", "size", "target").collect():
        said = hashlib.md5(r["text"].encode()).hexdigest()
        key = hashlib.md5(f"{seed}:{r['doc_id']}:{said}".encode()).hexdigest()
        order.setdefault(r["source"], []).append((key, r["doc_id"], r["size"], r["target"]))
    for source, found in order.items():
        left, draws[source] = round(found[0][3]), []
        for epoch in range(3):
            for _, i, size, _ in sorted(found):
                if min(size, left) > 0:
                    draws[source].append((i, epoch, min(size, left)))
                    left -= min(size, left)
    shares = mixing.split_quotas(np.array([len(draws[s]) for s in sorted(draws)]), n_shards, seed)
    want = {}
    for line, source in zip(shares, sorted(draws), strict=True):
        shard = np.repeat(np.arange(n_shards), line)
        want.update({(i, e): (s, w) for (i, e, w), s in zip(draws[source], shard.tolist(), strict=True)})
    assert got == want
    quotas = {(r["source"], r["shard"]): r["n_draws"] for r in mixing.shard_quotas(mixed).collect()}
    assert quotas == {("ab"[i], j): n for (i, j), n in np.ndenumerate(shares) if n}


def test_rows_without_ids_spread_over_the_order(spark):
    docs = frame(spark, [doc(None, f"text {i}") for i in range(2000)])
    keys = mixing._sized(docs, 7).groupBy(F.substring("_key", 1, 2)).count().collect()
    assert len(keys) > 200 and max(r["count"] for r in keys) < 40


def test_the_mix_is_laid_by_shard_and_place(spark):
    docs = frame(spark, [doc(i, f"text {i}", source="ab"[i % 2]) for i in range(60)]).withColumn("size", F.lit("mine"))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and {r["size"] for r in out.collect()} == {"mine"}
    assert out.count() == 90 and "Sort [_shard" in out._jdf.queryExecution().toString()


# ---------------------------------------------------------------- extra columns

OWN = (
    "_index _epochs _n _rest _rows0 _before _rank _words0 _words _rows _source _bucket _key _tie _size _draw _shard"
    " _place _text _gone _spans _first _places _stay _id _doc _at _row _said _y held_key features"
).split()


def test_columns_named_like_the_operators_own_pass(spark):
    rows = [doc(i, t) for i, t in enumerate(texts(5, 30))] + [doc(40, None), doc(None, "no id")]
    docs = frame(spark, rows).withColumns({c: F.lit(f"{c} mine") for c in OWN})
    items = spark.createDataFrame([("i", rows[0][1])], "item_id STRING, text STRING")
    made = {
        "mix": mixing.mix(docs),
        "mixed": mixing.mixed_documents(docs),
        "clean": decontam.clean_documents(docs, items),
        "bytes": repeats.remove_repeats(docs),
        "lines": linedup.remove_lines(docs),
        "one": neardup.one_of_each(docs),
        "shard": sharding.shard(docs, 3),
        "quality": quality.score(docs, None),
    }
    for name, out in made.items():
        found = out.select(*OWN).distinct().collect()
        assert [r.asDict() for r in found] == [{c: f"{c} mine" for c in OWN}], name
        assert out.columns[: len(docs.columns)] == docs.columns, name


# ---------------------------------------------------------------- lines


def brute_lines(rows, percent=80):
    seen, out = [], []
    for i, text in rows:
        lines = [] if text is None else text.split("\n")
        kept, said = [], 0
        for j, line in enumerate(lines):
            w = set(line.encode().split())
            if not w:
                continue
            said += 1
            if not any(100 * len(w & s) >= percent * len(w | s) for s in seen):
                kept.append(j)
            seen.append(w)
        out.append((i, len(lines), said - len(kept), ",".join(map(str, kept))))
    return out


def test_repeated_lines_are_exact(spark):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    base = [[draw.choice(words) for _ in range(draw.randint(1, 25))] for _ in range(15)]

    def line():
        w = list(draw.choice(base))
        for _ in range(draw.randint(0, 3)):
            w[draw.randrange(len(w))] = draw.choice(words)
        return draw.choice([" ", "\t"]).join(w)

    rows = [(i, "\n".join(draw.choice([line(), line(), "", "  "]) for _ in range(draw.randint(0, 8)))) for i in range(60)]
    rows += [(70, None), (71, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    found = linedup.line_report(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == brute_lines(rows)
    out = {r["doc_id"]: r["text"] for r in linedup.remove_lines(docs).collect()}
    for (i, text), (_, _, _, kept) in zip(rows, brute_lines(rows), strict=True):
        if text is not None:
            stay = {int(x) for x in kept.split(",") if x}
            lines = text.split("\n")
            assert out[i] == "\n".join(x for j, x in enumerate(lines) if j in stay or not x.split())


def test_repeated_lines_of_odd_rows(spark):
    docs = frame(spark, odd(extra=("x",)), ", _key STRING")
    rows = linedup.line_report(docs.withColumnRenamed("_key", "line")).collect()
    assert len(rows) == docs.count()
    assert sorted(r["n_removed"] for r in rows if r["doc_id"] == 9) == [0, 39]
    assert linedup.line_report(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- chats


@pytest.mark.parametrize("most", [8 << 20, 40])
def test_chats_round_trip(spark, monkeypatch, most):
    from opinweave.llm import common

    draw = random.Random(7)
    bits = ["<|im_end|>", "<|", "|", "<", "\\", "\\|", "\n", "é", "hello ", "<|im_start|>assistant\nok", "\\n", "漢字"]
    say = lambda: "".join(draw.choice(bits) for _ in range(draw.randint(0, 12)))
    roles = ["user", "assistant", "system", None, "a\nb<|\\"]
    rows = [(draw.choice([1, 2, 3, None, 9]), draw.randint(0, 9), draw.choice(roles), draw.choice([say(), None])) for _ in range(80)]
    rows += rows[:3]
    kinds = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
    turns = spark.createDataFrame(rows, kinds).withColumn("formatted", F.lit(1))
    monkeypatch.setattr(chat, "small_batches", lambda b, c: common.small_batches(b, c, most))
    found = {r["conv_id"]: r for r in chat.format_chats(turns).collect()}
    report = {r["conv_id"]: r for r in chat.chat_report(turns).collect()}
    assert set(found) == {r[0] for r in rows}
    for conv, r in found.items():
        own = sorted((x[1], x[2] or "", x[3] or "") for x in rows if x[0] == conv)
        want = [(role, text) for _, role, text in own]
        assert chat.read_chat(r["formatted"]) == want
        loss = [t for role, t in want if role == "assistant"]
        raw = r["formatted"].encode()
        spans = zip(r["loss_starts"], r["loss_ends"], strict=True)
        assert [chat.unescape(raw[a:b].decode()) for a, b in spans] == loss
        digest = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
        assert report[conv]["turns_sha256"] == digest and report[conv]["n_turns"] == len(want)
        assert report[conv]["loss_sha256"] == hashlib.sha256("".join(loss).encode()).hexdigest()
        assert report[conv]["loss_chars"] == sum(map(len, loss))
    assert chat.format_chats(turns.limit(0)).count() == 0


# ---------------------------------------------------------------- shards


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 1025])
def test_permutation_is_a_bijection(n):
    x = np.arange(n)
    y = sharding.permuted(x, n, seed=5)
    assert sorted(y.tolist()) == x.tolist()
    assert (sharding.permuted(y, n, seed=5, back=True) == x).all()


def test_shards_are_even_and_gapless(spark):
    docs = frame(spark, odd(extra=(1,)) + [doc(100 + i, f"t{i}") + (1,) for i in range(200)], ", shard INT")
    out = sharding.shard(docs, 8)
    rows = out.collect()
    assert len(rows) == docs.count() and out.columns == [*docs.columns[:-1], "shard", "slot"]
    counts = {}
    for r in rows:
        counts.setdefault(r["shard"], []).append(r["slot"])
    assert set(counts) == set(range(8)) and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    again = sharding.shard(docs.repartition(5), 8)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    report = {r["doc_id"]: r for r in sharding.shard_report(docs, 8).collect()}
    assert report[1]["size"] == 16 and report[4]["text_crc32"] == zlib.crc32(b"word")
    assert sharding.shard(docs.limit(0), 8).count() == 0


def test_shard_files(spark, tmp_path):
    docs = frame(spark, [doc(i, f"t{i}") for i in range(50)])
    out = sharding.shard(docs, 4)
    sharding.write_shards(out, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).select(*out.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, out.collect()))
