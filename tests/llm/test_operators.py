"""The text operators against plain Python on odd rows, empty tables and small crafted cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runlens.llm import (
    bytes as B,
    decontamination,
    exact_dedup,
    html_text,
    jaccard_join,
    lm,
    mixing,
    quality,
    sharding,
    suffix_dedup,
    toxicity,
)
from runlens.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text, lower=True):
    data = (text or "").encode()
    return WORD.findall(data.translate(LOWER) if lower else data)


# ---------------------------------------------------------------- words and digests

@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n.漢", max_size=30)), max_size=8), st.integers(1, 40))
def test_words_of_runs(texts, limit):
    got = []
    for run in B.slices(pa.array(texts, pa.string()), limit):
        w = B.words(run, lower=True)
        got += [[bytes(B._LOWER[run.buf][a:b]) for a, b in zip(w.starts[x:y], w.ends[x:y])]
                for x, y in zip(w.first[:-1], w.first[1:])]
    assert got == [words(t) for t in texts]


def test_digests_do_not_depend_on_the_place():
    run = next(B.slices(pa.array(["one two one two"])))
    w = B.words(run)
    assert w.ids[0] == w.ids[2] and w.ids[1] == w.ids[3] and w.ids[0] != w.ids[1]


# ---------------------------------------------------------------- 1 html

@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain & simple", "plain & simple"), ("a<br>b", "a\nb"),
    ("<p>one<p>two", "one\n\ntwo"), ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
    ("<ol start=4><li>a<li value=9>b<li>c</ol>", "4. a\n9. b\n10. c"),
    ("<table><tr><th>Name<th>N<tr><td>alpha<td>1<tr><td>b</table>", "Name   N\nalpha  1\nb"),
    ("<table><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab    c\n1   2  3".replace("ab    c", "ab     c")),
    ("<pre>\n a\n  b</pre>x", " a\n  b\n\nx"), ("<div hidden>a</div>b", "b"), ("<p style='color:red; display : none'>a</p>b", "b"),
    ("<details><summary>s</summary>gone</details><details open>kept</details>", "s\nkept"),
    ("<script>if (a<b) '</p>'</script><!-- <p>x -->t", "t"), ("<title>t</title><body>&lt;b&gt; &eacute;</body>", "<b> é"),
    ("</p>x</div></li>", "x"), ("<a title='>'>q</a>", "q"), ("a <b>b</b>  <i> c</i>", "a b c")])
def test_visible_text(page, text):
    assert html_text.visible_text(page) == text


def test_deep_and_broken_pages():
    deep = "<div><span>" * 20_000 + "end"
    assert html_text.visible_text(deep) == "end"
    assert html_text.visible_text("<" * 50_000).count("<") == 50_000


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "<b>", "</b>",
                                 "<div>", "</div>", "w1 ", "w2 ", "w3 ", "<h1>", "<br>", "<dd>", "<option>", "<blockquote>"]), max_size=30))
def test_no_visible_word_is_lost(parts):
    shown = html_text.visible_text("<body>" + "".join(parts))
    assert Counter(re.findall(r"w\d", shown)) == Counter(re.findall(r"w\d", "".join(parts)))


@pytest.mark.parametrize("part", ["x <y ", "<" + "a" * 60, "<a ", '<a b="', "<a b='", "<a<", "</script ", "<!x ", "<?x ", '<a "" ', "<a '\"' ", "&lt;<b"])
@pytest.mark.parametrize("head", ["", "<script>", "<table><tr>"])
def test_html_of_any_kind_takes_linear_time(part, head):
    import time

    took = {}
    for size in (100_000, 400_000):
        page = head + part * (size // len(part)) + '">"'
        begun = time.process_time()
        html_text.visible_text(page)
        took[size] = time.process_time() - begun
    assert took[400_000] < 8 * took[100_000] + 0.5


@pytest.mark.parametrize("span", ["\u00b2", "9" * 5000, "", "-1", "x", "1e3", "\u0663"])
def test_html_odd_spans_count_as_one(span):
    page = f"<table><tr><td colspan='{span}' rowspan='{span}'>a<td>b<tr><td>c<td>d</table>"
    assert html_text.visible_text(page) == "a  b\nc  d"


def test_html_cells_over_several_rows():
    page = "<table><tr><td rowspan=2>aa<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>"
    assert html_text.visible_text(page) == "aa  b  c\n    d  e\nf   g  h"
    page = "<table><tr><td>x<td rowspan=2 colspan=2>yy<td>z<tr><td>1<td>2</table>"
    assert html_text.visible_text(page) == "x  yy    z\n1        2"
    page = "<table><thead><tr><th rowspan=0>h<th>i<tr><th>j<tbody><tr><td>k<td>l</table>"
    assert html_text.visible_text(page) == "h  i\n   j\nk  l"


def test_html_tags_that_do_not_end_are_text():
    assert html_text.visible_text('1 <b and "2') == '1 <b and "2'
    assert html_text.visible_text('<a "<b>" x') == '<a "" x'
    assert html_text.visible_text("a<b c='>'>d</b >e<!-- f") == "ade"


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "<p>a", "old"), (None, None, None), (1, "<p>a", "old")], "page_id long, html string, text string")
    assert sorted(map(tuple, html_text.extract(pages).collect()), key=repr) == [(1, "a"), (1, "a"), (None, "")]
    assert html_text.extract(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- 2 sharding

def check_shards(rows, n):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(n))


def test_shards_of_odd_rows(odd, none):
    out = sharding.shard(odd, n_shards=5)
    assert out.columns == [c for c in odd.columns if c != "slot"] + ["shard", "slot"]
    rows = out.collect()
    assert len(rows) == odd.count()
    check_shards(rows, 5)
    assert sharding.shard(none, n_shards=5).count() == 0


def test_shards_are_even_and_keep_small_groups(spark, prose):
    texts = [prose(30 + i % 50, i) for i in range(900)] + [prose(60, 9999)] * 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard(df, n_shards=6).collect()
    check_shards(rows, 6)
    size, where = Counter(), defaultdict(set)
    for r in rows:
        size[r.shard] += len(r.text.encode()) + 16
        where[r.text].add(r.shard)
    mean = sum(size.values()) / 6
    assert all(abs(s - mean) < 0.05 * mean for s in size.values())
    assert all(len(v) == 1 for t, v in where.items() if t != texts[-1])


# ---------------------------------------------------------------- 3 exact dedup

def plain_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return groups


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_over_batches(spark, odd, tmp_path, weak):
    from pyspark.sql import functions as F

    path = str(tmp_path / "docs")
    odd.select("doc_id", "text", "source").repartition(4).write.parquet(path)
    digest = (lambda t: F.unhex(F.lpad(F.hex(F.crc32(t) % 3), 4, "0"))) if weak else exact_dedup.sha256
    rows = exact_dedup.deduplicate(spark, path, digest=digest, files_per_batch=1).collect()
    groups = plain_groups([(r.doc_id, r.text) for r in odd.collect()])
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(rows) == odd.count() and {r.text_sha256 for r in rows} == set(by_sha)
    for r in rows:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert (r.group_size, r.keep_id) == (len(ids), max(known) if known else None)
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(by_sha.keys())
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    path, state, updates = (str(tmp_path / x) for x in ("docs", "state", "updates"))
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(path)
    exact_dedup.run_stream(spark, path, state, updates)
    spark.createDataFrame([(3, "a")], "doc_id long, text string").write.mode("append").parquet(path)
    exact_dedup.run_stream(spark, path, state, updates)
    assert sorted((r.group_size, r.keep.id) for r in exact_dedup.groups_of(spark, updates).collect()) == [(1, 2), (2, 3)]


def test_exact_dedup_of_nothing(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    assert exact_dedup.deduplicate(spark, path).count() == 0


# ---------------------------------------------------------------- 4 repeated strings

def removed_by_hand(texts, width):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        mark = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if count[d[i:i + width]] > 1:
                mark[i:i + width] = b"\1" * width
        kept = bytes(x for x, m in zip(d, mark) if not m)
        out.append((len(d), sum(mark), sum(m and (not i or not mark[i - 1]) for i, m in enumerate(mark)), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_strings_of_odd_rows(odd, none):
    rows = [r for r in odd.collect() if r.text is None or len(r.text) < 20_000 or r.doc_id in (5, 6)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(odd).collect())
    assert got == Counter((r.doc_id, *x) for r, x in zip(rows, removed_by_hand([r.text for r in rows], 200)))
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeated_strings_with_edits(spark, prose, seed):
    rng = np.random.default_rng(seed)
    base = [prose(80, 100 * seed + i) for i in range(3)]
    texts = []
    for i in range(40):
        t = list("|".join(base[j] for j in rng.integers(0, 3, 3)))
        for at in rng.integers(0, len(t), rng.integers(0, 6)):
            t[at] = "#%é"[i % 3]
        a, b = sorted(rng.integers(0, len(t), 2))
        texts.append("".join(t[a:b]) + ("z" * int(rng.integers(0, 500)) if i % 5 == 0 else ""))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, with_bytes=True).collect()}
    for i, want in enumerate(removed_by_hand(texts, 200)):
        r = rows[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want
        assert hashlib.sha256(r.kept).hexdigest() == want[3]


# ---------------------------------------------------------------- 5 and 9 classifiers

def labelled(spark, prose, mark):
    rows, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        rows.append((i, prose(60, i) + ("" if good else mark(i)), "en", "a"))
        labels.append((i, int(good), int(not good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out(spark, prose, odd, none):
    docs, labels = labelled(spark, prose, lambda i: " stub stub stub stub stub !!! buy now")
    w = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, w).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 40 and all((got[i] >= 0.5) == (i % 4 > 0) for i in held)
    assert all(0 <= r.score <= 1 for r in quality.score(odd, w).collect())
    assert quality.score(none, w).count() == 0
    assert not quality.train(docs, labels.limit(0)).any()


def test_quality_dot_product():
    run = next(B.slices(pa.array(["a a b!", "", None, "b"])))
    doc, at, x = quality.features(run)
    assert set(doc) == {0, 3} and np.allclose([np.sum(x[doc == d] ** 2) for d in (0, 3)], 1)


def test_toxicity_on_held_out(spark, prose, odd, none):
    bad = ["scumbag", "vermin", "blockhead", "rotten"]
    docs, labels = labelled(spark, prose, lambda i: f" {bad[i // 4 % 4]}, {bad[(i // 4 + 1) % 4].upper()}!")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i].score >= 0.5) == (i % 4 == 0) for i in held)
    assert all(r.evidence[0].label == 1 for i, r in got.items() if i % 4 == 0)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if i % 4}
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.train(docs, labels.limit(0))
    assert len({r.score for r in toxicity.score(docs, empty).collect()}) == 1


def test_every_word_that_speaks_for_the_label_is_used(spark, prose):
    """150 words go with the label alike, each in a few documents: none of them may be cut off."""
    rows = [(i, prose(8, i) + (f" bad{i // 3 % 150}" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(2700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    trained = Counter(i // 3 % 150 for i, _, y in rows if y and zlib.crc32(str(i).encode()) % 5)
    model = toxicity.train(docs.drop("toxic"), docs.drop("text"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    marked = [i for i, _, y in rows if y and trained[i // 3 % 150] >= 3]
    assert len(marked) > 800 and all(got[i].evidence and got[i].evidence[0].label == 1 for i in marked)
    assert len({i // 3 % 150 for i in marked if got[i].score >= 0.5}) > 140


def test_nearest_is_exact():
    rng = np.random.default_rng(3)
    dense = rng.random((700, 20)) * (rng.random((700, 20)) < 0.2)
    norm = np.linalg.norm(dense, axis=1, keepdims=True)
    dense = np.divide(dense, norm, out=np.zeros_like(dense), where=norm > 0)
    index = toxicity.BlockMaxIndex(np.arange(20, dtype=np.uint64), np.ones(20), np.arange(700), np.zeros(700), dense)
    for _ in range(50):
        term = np.sort(rng.choice(20, 4, replace=False))
        weight = rng.random(4) + 0.1
        _, found = index.nearest(term, weight, 15)
        every = np.sort(index.vectors[:, term] @ (weight / np.linalg.norm(weight)).astype(np.float32))[::-1][:15]
        assert np.allclose(found, every[every > 0], atol=1e-5)


def test_short_lists_give_what_blocks_give(monkeypatch):
    rng = np.random.default_rng(4)
    dense = rng.random((700, 20)) * (rng.random((700, 20)) < 0.2)
    index = toxicity.BlockMaxIndex(np.arange(20, dtype=np.uint64), np.ones(20), np.arange(700), np.zeros(700), dense)
    queries = [(np.sort(rng.choice(20, 4, replace=False)), rng.random(4) + 0.1) for _ in range(30)]
    whole = [index.nearest(*q, 15, leave_out=3) for q in queries]
    monkeypatch.setattr(toxicity, "SHORT_LISTS", -1)
    for (near, cosines), q in zip(whole, queries):
        got = index.nearest(*q, 15, leave_out=3)
        assert np.array_equal(got[0], near) and np.array_equal(got[1], cosines)


# ---------------------------------------------------------------- 6 mixing

@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text(max_size=3)), st.integers(0, 1000), min_size=1, max_size=12))
def test_targets(sizes):
    out = mixing.targets(sizes)
    assert set(out) == set(sizes) and all(out[s] <= 3 * sizes[s] + 1e-6 for s in sizes)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    free = [s for s in sizes if out[s] < 3 * sizes[s] - 1e-6]
    assert math.isclose(sum(out.values()), sum(sizes.values()), rel_tol=1e-9, abs_tol=1e-6)
    assert len({round(out[s] / weight[s], 6) for s in free}) <= 1


def test_permutation_and_draws():
    for n in (1, 2, 3, 17, 1000):
        index = np.arange(n)
        got = mixing.permute(index, np.full(n, n), np.full(n, 99))
        assert sorted(got) == list(range(n))
    quotas = np.array([5, 0, 700, 31])
    counts = mixing.draw_counts(quotas, 50, 1)
    assert (counts.sum(axis=0) == quotas).all() and (counts.sum(axis=1)[:-1] == 50).all()


def test_mix_of_odd_rows(odd, none):
    rows, used = mixing.taken_pieces(odd)
    taken = Counter()
    for r in used.collect():
        assert 1 <= r.uses <= 3 and r.n_words > 0
        taken[r._id] += r.n_words * r.uses
    sizes = defaultdict(int)
    for r in odd.collect():
        sizes[r.doc_id] += len(words(r.text, lower=False))
    assert all(taken[i] <= 3 * sizes[i] for i in taken)
    assert rows.count() == odd.count() and mixing.taken_pieces(none)[1].count() == 0
    assert mixing.mixed_documents(none).count() == 0


def test_mix_tells_rows_of_one_id_apart(spark):
    rows = [(1, "a b c " * 40, "s"), (1, "d e " * 60, "t"), (2, "x y " * 50, "s"), (1, "d e " * 60, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, used = mixing.taken_pieces(docs)
    taken = Counter()
    for r in used.collect():
        taken[r._row] += r.n_words * r.uses
    got = sizes.collect()
    assert len({r._row for r in got}) == 4
    assert all(taken[r._row] <= 3 * r._size for r in got)
    per_source = Counter()
    for r in mixing.mixed_documents(docs).collect():
        per_source[r.source] += len(words(r.text))
    want = Counter()
    for r in got:
        want[r._name] += taken[r._row]
    assert per_source == want


def test_mixed_documents_hold_what_is_taken(spark, prose):
    docs = spark.createDataFrame([(i, prose(20 + i * 7, i), "en", "ab"[i % 2] if i % 5 else None, 0) for i in range(60)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    _, used = mixing.taken_pieces(docs)
    want = Counter()
    for r in used.collect():
        want[r._id] += r.n_words * r.uses
    out = mixing.mixed_documents(docs)
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert out.columns == docs.columns and got == want
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, mixing.mixed_documents(docs).collect()), key=repr)
    assert mixing.mixed_blocks(docs).agg({"n_words": "sum"}).first()[0] == sum(want.values())


# ---------------------------------------------------------------- 7 decontamination

def tokens(text):
    return [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", (text or "").lower()) if w]


def leaks_by_hand(docs, items):
    best = {}
    for d, text in docs:
        w = tokens(text)
        h = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        for item, passage in items:
            v = tokens(passage)
            a = Counter(tuple(v[i:i + 5]) for i in range(len(v) - 4))
            for start in range(len(h)):
                b = Counter(h[start:start + sum(a.values())])
                shared = sum((a & b).values())
                s = shared / (sum(a.values()) + sum(b.values()) - shared) if a else 0
                if s >= 0.8:
                    best[d, item] = max(best.get((d, item), 0), s)
    return best


def test_leaks_against_all_windows(spark, prose, odd_rows):
    items = [(1, prose(30, 901)), (2, prose(45, 902)), (3, "too short"), (4, None), (5, prose(20, 903)), (1, prose(25, 904)),
             (6, "again and " * 12), (5, prose(20, 903))]
    docs = [(r[0], r[1]) for r in odd_rows if not r[1] or len(r[1]) < 20_000]
    for i, (_, p) in enumerate(x for x in items if x[1] and len(x[1]) > 20):
        w = p.split()
        docs += [(500 + i, prose(80, i) + ", " + p.upper() + ". " + prose(40, i)), (520 + i, p), (540 + i, "(" + " ".join(w[1:]) + ")"),
                 (560 + i, prose(9, i) + " " + " ".join(w[:-1]) + " " + prose(9, i)),
                 (580 + i, prose(50, i) + " " + " ".join(w[:8]) + " changed " + " ".join(w[9:]) + " " + prose(50, i)), (600 + i, " ".join(w[:len(w) // 2]))]
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = leaks_by_hand(docs, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert len(want) >= 20


def test_clean_keeps_columns(spark, odd, none, prose):
    bench = spark.createDataFrame([(1, prose(40, 100)), (2, None)], "item_id long, text string")
    out = decontamination.clean(odd, bench)
    assert out.columns == odd.columns and out.count() in (odd.count(), odd.count() - 1)
    assert decontamination.clean(none, bench).count() == 0
    assert decontamination.clean(odd, bench.limit(0)).count() == odd.count()


# ---------------------------------------------------------------- 8 language model

def test_base_scores_by_hand(odd, none):
    rows = odd.collect()
    count = Counter()
    held = lambda r: zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 == 2
    for r in rows:
        if not held(r):
            count.update([*words(r.text), None])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for r in rows:
        t = [*words(r.text), None]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t)
        want[r.doc_id, held(r), len(t), sum(count[x] > 0 for x in t), n, round(base, 5)] += 1
    got = lm.score_documents(odd, head_limit=64, classes=16).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    # Where a count lies, on the driver or in the table, changes nothing.
    whole = lm.score_documents(odd, head_limit=100_000, classes=16).collect()
    assert sorted(round(r.score, 6) for r in whole) == sorted(round(r.score, 6) for r in got)
    assert lm.score_documents(none).count() == 0


def test_pairs_of_words_outside_the_classes_count(spark):
    """Words of the shared class: a pair seen in training scores better than the same words in an order never seen."""
    rng = random.Random(1)
    names = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(f"{a} {a}x" for a in rng.choices(names, k=30)), ) for i in range(300)]
    left = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows += [(left[0], "w1 w1x w2 w2x w3 w3x"), (left[1], "w1 w2x w2 w3x w3 w1x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = []
    for limits in ({"head_limit": 8}, {"head_limit": 1000, "pair_limit": 0}):
        got = {r.doc_id: r for r in lm.score_documents(docs, classes=2, **limits).collect()}
        seen, unseen = (got[i] for i in left)
        assert abs(seen.base_score - unseen.base_score) < 1e-9 and seen.score > unseen.score + 3
        scores.append({i: round(r.score, 5) for i, r in got.items()})
    # Where a pair's count lies, on the driver or in the table, changes nothing.
    assert scores[0] == scores[1]


def test_mixture_weights_raise_the_likelihood():
    rng = np.random.default_rng(5)
    kept, held = rng.poisson(3, (20, 20)), rng.poisson(1, (20, 20))
    model = lm.class_model(kept, held).astype(float)
    assert np.allclose((10 ** model).sum(axis=1), 1, atol=1e-4)
    one = (kept + held).sum(axis=0) / (kept + held).sum()
    assert (held * model).sum() > (held * np.log10(one)).sum()


def test_pairs_are_summed_and_stored_by_group(spark, prose):
    """One row per group of pairs, not one per pair: a pair then costs a few array operations, not a row in each step."""
    texts = [prose(30 + i % 7, i // 3) for i in range(60)] + ["rare%d common rare%d" % (i, i) for i in range(20)] + ["", None]
    rows = lm._folds(spark.createDataFrame(list(enumerate(texts)), "id long, text string").fillna(""))
    head = lm.Head(lm._word_counts(rows), 40, 8)
    groups = 5
    got = lm._word_pairs(rows, head, 8, groups).collect()
    assert len(got) <= 2 * groups + 1 and len({(r.kind, r.grp) for r in got}) == len(got)
    plain, rare, cells = Counter(), Counter(), Counter()
    for i, text in enumerate(texts):
        t = lm.Tokens(next(B.slices(pa.array([text or ""]))))
        v, w, key = head.pairs(t)
        cls = head.find(t.ids)[2]
        fold = zlib.crc32(str(i).encode()) % 7
        side = 1 if fold == lm.HELD else 2 if fold == lm.LEFT_OUT else 0
        for a, b, k, c, d in zip(v.tolist(), w.tolist(), key.tolist(), t.before(cls).tolist(), cls.tolist()):
            (plain if k >= 0 else rare)[(k, side) if k >= 0 else (a, b, side)] += 1
            cells[c * 8 + d, side] += side < 2
    have = {kind: {} for kind in (lm.PLAIN, lm.RARE, lm.CLASS)}
    for r in got:
        for j, k in enumerate(r.key):
            have[r.kind][(k, r.w[j]) if r.kind == lm.RARE else k] = (r.kept[j], r.held[j], r.n[j] if r.n else None)
    by_hand = {k: tuple(plain[k, s] for s in range(3)) for k, _ in plain}
    assert have[lm.PLAIN] == {k: (c[0], c[1], sum(c)) for k, c in by_hand.items() if sum(c) > 1}
    by_hand = {(a, b): tuple(rare[a, b, s] for s in range(3)) for a, b, _ in rare}
    assert have[lm.RARE] == {k: (c[0], c[1], sum(c)) for k, c in by_hand.items()}
    assert have[lm.CLASS] == {k: (cells[k, 0], cells[k, 1], None) for k, s in cells if cells[k, 0] or cells[k, 1]}
    assert len(have[lm.PLAIN]) > 20 and len(have[lm.RARE]) > 20


def test_lookup_of_digests():
    rng = np.random.default_rng(3)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 63, 500, dtype=np.uint64) * B.U64(2), np.arange(40, dtype=np.uint64),
                                     np.array([(1 << 64) - 1, (1 << 64) - 2], np.uint64)]))
    ask = np.concatenate([keys, keys + B.U64(1), rng.integers(0, 1 << 63, 500, dtype=np.uint64)])
    places = {int(k): i for i, k in enumerate(keys)}
    for n in (0, 1, 2, len(keys)):
        assert lm.Lookup(keys[:n]).find(ask).tolist() == [p if (p := places.get(int(a), -1)) < n else -1 for a in ask]


# ---------------------------------------------------------------- 10 Jaccard join

def join_by_hand(rows, n=3, percent=90):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return Counter((r[0], len(sets[i]), min(least[find(i)], default=None) if sets[i] else r[0]) for i, r in enumerate(rows))


def test_join_of_odd_rows(odd, none):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(odd).collect())
    assert got == join_by_hand([(r.doc_id, r.text) for r in odd.collect()])
    assert jaccard_join.join(none).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_join_of_a_near_copy_family(spark, prose, seed):
    rng = np.random.default_rng(seed)
    base, rows = prose(150, 77 + seed).split(), []
    for i in range(150):
        w = list(base)
        for at in rng.integers(0, len(w), rng.integers(0, 9)):
            w[at] = f"edit{rng.integers(0, 40)}"
        rows.append((i, " ".join(w[:int(rng.integers(130, 151))])))
    rows += [(200 + i, prose(100, 500 + i) + " " + " ".join(base[:20])) for i in range(40)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in
                  jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == join_by_hand(rows)


def test_chance_meetings_make_no_family(spark):
    """Rows that share one frequent n-gram only are not compared with a pivot, which costs its whole set for each."""
    alone = [(i, 400, 41, 7, 1, 60) for i in range(60)]
    family = [(100 + i, 400, 41, 7, 10 + k, 40) for i in range(40) for k in range(30)]
    few = [(200 + i, 400, 41, 7, 50 + k, 32) for i in range(4) for k in range(30)]
    block = spark.createDataFrame(alone + family + few, "nid long, n long, p int, last long, k long, rows long")
    got = {r.nid: r.pivot for r in jaccard_join._families(block, 90).collect()}
    assert set(got) == {100 + i for i in range(40)} and len(set(got.values())) == 1


def test_join_claims_no_count_of_links(odd):
    """Pairs inside a connected component are not compared, so a count of links would be too low."""
    assert jaccard_join.join(odd).columns == ["doc_id", "n_shingles", "component_id"]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
