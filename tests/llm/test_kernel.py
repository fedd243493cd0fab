import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tempograph.llm.common import pairs_in_runs
from tempograph.llm.features import bag_of, stats_of
from tempograph.llm.lines import edits
from tempograph.llm.suffix import multikey_sort
from tempograph.llm.textkernel import Lines, Words, chunks, simhash, strings, text_bytes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n.,|ßÉ9_", max_size=30)), max_size=8))
def test_words_and_lines_as_by_regex(texts):
    w = Words.of(pa.array(texts, pa.string()))
    got = strings(w.data, w.start, w.end)
    want = [m.decode() for t in texts for m in re.findall(rb"[A-Za-z0-9_\x80-\xff]+", (t or "").encode())]
    assert got == want
    lines = Lines(w)
    assert strings(w.data, lines.start, lines.end) == [x for t in texts for x in (t or "").split("\n")]
    by = {}
    for s, h in zip(got, w.hash.tolist(), strict=True):
        assert by.setdefault(s.lower(), h) == h
    assert len(set(by.values())) == len(by)


def test_chunks_keep_whole_texts():
    b = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 100, "", "c"]})
    got = [x for c in chunks([b], most=12) for x in c.column("text").to_pylist()]
    assert got == ["a" * 10, None, "b" * 100, "", "c"]


def test_simhash_as_by_hand():
    rng = np.random.default_rng(1)
    h, w, g = rng.integers(0, 2**63, 50).astype(np.uint64), rng.random(50), np.sort(rng.integers(0, 4, 50))
    from tempograph.llm.textkernel import mix

    got = simhash(h, w, g, 5, 2)
    for k in range(5):
        for lane in range(2):
            m = mix(h, 100 + lane)[g == k]
            bits = [sum(x if (int(v) >> b) & 1 else -x for v, x in zip(m, w[g == k], strict=True)) > 1e-4 for b in range(64)]
            assert int(got[k, lane]) == sum(1 << b for b in range(64) if bits[b])


def test_multikey_sort_orders_and_shares():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 3, (300, 6)).astype(np.uint32)
    seg = rng.integers(0, 4, 300)
    order, common = multikey_sort(keys, seg)
    rows = [(seg[i], *keys[i]) for i in order]
    assert rows == sorted(rows)
    for p in range(300):
        if p == 0 or seg[order[p]] != seg[order[p - 1]]:
            assert common[p] == -1
        else:
            a, b = keys[order[p]], keys[order[p - 1]]
            assert common[p] == next((i for i in range(6) if a[i] != b[i]), 6)
    assert len(multikey_sort(keys[:0], seg[:0])[0]) == 0


def test_pairs_in_runs():
    first, last = np.array([1, 2, 3, 9]), np.array([4, 4, 3, 5])
    got = [(int(a), int(b)) for i, j in pairs_in_runs(first, last, 2) for a, b in zip(i, j, strict=True)]
    assert got == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)]


def _edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_edits():
    r = random.Random(3)
    for _ in range(1500):
        a = "".join(r.choice("abc") for _ in range(r.randrange(0, 20)))
        b = "".join(r.choice("abc") for _ in range(r.randrange(0, 20))) if r.random() < 0.5 else a[: r.randrange(0, 20)] + "x" + a[r.randrange(0, 20) :]
        most, d = r.choice([0, 1, 3, 50]), _edits(a, b)
        e = edits(a, b, most)
        assert e == d if d <= most else e > most


def test_features_of_empty_and_null():
    w = Words.of(pa.array([None, "", "...", "a a b"]))
    s = stats_of(w)
    assert s.shape[0] == 4 and not np.isnan(s).any()
    doc, bucket, value = bag_of(w, 64)
    assert doc.tolist() == [3, 3] and abs((value**2).sum() - 1) < 1e-9
    assert text_bytes(pa.array([], pa.string()))[1].tolist() == [0]
