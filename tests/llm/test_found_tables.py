"""Each pN_found query against a brute-force version on the smallest tables."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations

import pyarrow.parquet as pq
import pytest

from tomegrid.llm import queries

WORD = re.compile(r"[^\W_]+")


def rows(small, name):
    return pq.read_table(f"{small}/{name}.parquet").to_pylist()


def words(t):
    return WORD.findall(t.lower())


def parts(content):
    head, _, body = content.partition("\n")
    return tuple(sorted(" ".join(words(f)) for f in re.split(r"\.(?:\s+|$)", head) if words(f))), words(body)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_p1(spark, small):
    def fits(units):
        return all(len(u.strip()) <= 900 for u in units)

    want = []
    for r in rows(small, "chunked"):
        t = r["content"]
        if t is None or len(t) <= 1000:
            continue
        lines = re.split(r"\r\n|\n|\r", t)
        blocks, own = [], []
        for line in lines:
            if line.strip():
                own.append(line)
            else:
                blocks.append("\n".join(own))
                own = []
        blocks.append("\n".join(own))
        kind = (
            "block" if fits(blocks) else "line" if fits(lines) else "sentence" if fits(s for x in lines for s in re.split(r"(?<=[.!?;…])\s+", x)) else "word" if fits(t.split()) else "none"
        )
        want.append((r["row_id"], kind))
    assert got(queries.p1_found(spark, small)) == sorted(want)


def test_p1_pieces_rebuild_the_content(spark, small):
    text = {r["row_id"]: r["content"] for r in rows(small, "chunked")}
    pieces = defaultdict(list)
    for p in queries.p1_pieces(spark, small).collect():
        assert len(p.content) <= 1000 and p.new_chars <= 900
        pieces[p.row_id].append(p)
    assert pieces
    for row, ps in pieces.items():
        ps.sort(key=lambda p: p.piece)
        assert "".join(p.content[len(p.content) - p.new_chars :] for p in ps) == text[row]
        for a, b in zip(ps, ps[1:]):
            assert b.content[: len(b.content) - b.new_chars] == text[row][max(0, b.start - 100) : b.start]


def test_p2_and_p3(spark, small):
    sets, groups = {}, defaultdict(list)
    for r in rows(small, "chunked"):
        if r["content"] is None:
            continue
        head, w = parts(r["content"])
        if w:
            groups[head, tuple(w)].append(r["row_id"])
        if len(set(w)) >= 20:
            sets[r["row_id"]] = (head, tuple(w), set(zip(w, w[1:], w[2:])))
    p3 = sorted((min(v), len(v)) for v in groups.values() if len(v) > 1)
    assert got(queries.p3_found(spark, small)) == p3
    p2 = []
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x[:2] != y[:2] and len(x[2] & y[2]) >= 0.6 * len(x[2] | y[2]):
            p2.append((a, b))
    assert got(queries.p2_found(spark, small)) == p2


def test_p2_groups_are_whole(spark, small):
    """One row a row of the table; groups and links at the parameters of problem 2, by brute force."""
    bodies, at = {}, {}
    for r in rows(small, "chunked"):
        w = parts(r["content"] or "")[1]
        at[r["row_id"]] = tuple(w) if len(set(w)) >= 20 else r["row_id"]
        if len(set(w)) >= 20:
            bodies[tuple(w)] = set(zip(w, w[1:], w[2:]))
    near = defaultdict(set)
    for a, b in combinations(bodies, 2):
        if len(bodies[a] & bodies[b]) >= 0.6 * len(bodies[a] | bodies[b]):
            near[a].add(b)
            near[b].add(a)
    root, want = {}, defaultdict(set)
    for b in bodies:
        todo = [b]
        while todo:
            if (x := todo.pop()) not in root:
                root[x] = b
                todo += near[x]
    for row, key in at.items():
        want[root.get(key, key)].add(row)
    out = queries.p2_groups(spark, small).collect()
    assert {r.row_id: r.links for r in out} == {row: len(near[key]) if key in bodies else 0 for row, key in at.items()} and len(out) == len(at)
    have = defaultdict(set)
    for r in out:
        have[r.group_id].add(r.row_id)
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, want.values()))


def test_p7(spark, small):
    windows = defaultdict(set)
    for i in rows(small, "exam_items"):
        w = words(i["text"])
        for k in range(len(w) - 11):
            windows[tuple(w[k : k + 12])].add(i["item_id"])
    want = set()
    for d in rows(small, "documents"):
        w = words(d["text"] or "")
        for k in range(len(w) - 11):
            want |= {(d["doc_id"], i) for i in windows.get(tuple(w[k : k + 12]), ())}
    assert got(queries.p7_found(spark, small)) == sorted(want)


def test_p6(spark, small):
    tiktoken = pytest.importorskip("tiktoken")
    from tomegrid.llm import tokens

    own = tokens.transducer(tokens.VOCABULARY)
    plain = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    text = {d["doc_id"]: d["text"] for d in rows(small, "documents")}
    out = queries.p6_ids(spark, small).collect()
    assert len(out) == len(text)
    for r in out:
        assert r.ids == plain.encode_ordinary(text[r.doc_id] or "")
        assert "".join(own.decode(r.ids)) == (text[r.doc_id] or "")


def test_p4_forms_equal_titles_and_codes(spark, small):
    from tomegrid.llm.glyphs import Forms

    codes = [c["code"] for c in rows(small, "latin_codes")]
    forms = Forms(codes)
    titles = {forms.form(t["title"]) for t in rows(small, "toc")}
    out = queries.p4_forms(spark, small).collect()
    assert {r.paragraph_form for r in out if r.paragraph_form} <= titles
    assert all(forms.changed(r.content_form) == 0 for r in out if r.content_form)
    found = set(queries.p4_found(spark, small).collect())
    assert {(r.row_id, "content") for r in out if r.content_changed} | {(r.row_id, "paragraph") for r in out if r.paragraph_changed} == {tuple(f) for f in found}


def test_p5_kinds_are_stable(spark, small):
    out = queries.p5_found(spark, small).collect()
    assert {r.kind for r in out} <= {"table", "list", "junk"} and len({r.row_id for r in out}) == len(out)


def test_p8_rates_agree_with_found(spark, small):
    found = queries.p8_found(spark, small).collect()
    rates = queries.p8_rates(spark, small).collect()
    for kind in ("abusive", "hateful", "sexual"):
        assert round(sum(r[f"{kind}_rate"] * r.documents for r in rates)) == sum(f.kind == kind for f in found)
