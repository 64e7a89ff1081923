"""Two tokenizers aligned, against a plain loop over whole texts."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runlens.llm import alignment
from runlens.llm.registry import table

A, B = f"{alignment.TOKENIZERS}/{alignment.A_FILE}", f"{alignment.TOKENIZERS}/{alignment.B_FILE}"


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(A, B)


def plain(pair, text):
    """(groups as lists of ids, links) of a whole text, token by token; None without tokens."""
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    if b"".join(pair.a_bytes[i] for i in a) != raw or b"".join(pair.b_bytes[i] for i in b) != raw:
        return None
    spans = []
    for ids, names in ((a, pair.a_bytes), (b, pair.b_bytes)):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(names[i]), i))
            at += len(names[i])
        spans.append(out)
    links, j = [], 0
    for lo, hi, i in spans[0]:
        while spans[1][j][1] <= lo:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < hi:
            links.append((i, spans[1][k][2]))
            k += 1
    ends = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
    groups = [([i for lo, hi, i in spans[0] if p < hi <= e], [i for lo, hi, i in spans[1] if p < hi <= e])
              for p, e in zip([0, *ends], ends)] if len(raw) < 3000 else None
    return a, b, len(ends), groups, links


def expected(pair, rows):
    found = [(i, plain(pair, t)) for i, t in rows]
    counts = Counter(x for _, f in found if f for x in set(f[4]))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, n, groups, links = f
        digest = None if groups is None else hashlib.sha256(";".join(
            ",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()
        out.append((i, len(a), len(b), n, len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), digest))
    return out


def same(got, want):
    known = {(w[:7]): w[7] for w in want}
    got = sorted((tuple(r)[:7] + ((tuple(r)[7] if known.get(tuple(r)[:7]) is not None else None),) for r in got), key=repr)
    assert got == sorted(want, key=repr)


ODD = [(1, " "), (2, "  two  spaces \n\n and\t tabs \n  "), (3, "<s> </s> <unk> <|endoftext|> are text"), (4, "a▁b ▁ c"),
       (5, "\x00\x1c \x1d x \x85 y z 　w"), (6, "漢字かな交じり文 mit Umläuten ß \U0001f600\U0001f469‍\U0001f469"), (7, "x" * 5000),
       (8, "don't  we'll 12345 3.14 \r\n end"), (9, "\n leading"), (10, "a\n  b \n  \n c"), (15, "ends in a space "), (11, "same"), (12, "same"), (None, "same")]


@pytest.mark.parametrize("limit", [alignment.HEAD, 40, 0])
def test_odd_rows(spark, odd, odd_rows, pair, limit):
    rows = [r[:2] for r in odd_rows] + ODD
    docs = odd.select("doc_id", "text", "n", "k").union(spark.createDataFrame([(*r, 1, 2) for r in ODD], "doc_id long, text string, n long, k long"))
    same(alignment.measures(docs, limit=limit).collect(), expected(pair, rows))


def test_sample(spark, pair):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    same(alignment.measures(docs).collect(), expected(pair, [(r.doc_id, r.text) for r in docs.collect()]))


def test_no_rows(spark, none):
    df = alignment.measures(none)
    assert df.collect() == [] and df.columns[0] == "doc_id"


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r'▁<>sé漢1"), st.characters(codec="utf-8")), min_size=1, max_size=40))
def test_segments_encode_as_whole_texts(pair, text):
    sizes, digests, n, keys, times = alignment.measured([text], alignment.Segments(pair))
    want = expected(pair, [(0, text)])[0]
    assert (*sizes[0].tolist(), digests[0]) == (*want[1:5], want[7]) and times.sum() == want[4]
