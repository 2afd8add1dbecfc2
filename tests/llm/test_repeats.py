import collections
import hashlib

import numpy as np
import pytest

from procweave.llm import substring_dedup, suffix_dedup, windows
from procweave.llm.common import identified


def by_bytes(docs, width, keep_first):
    """Brute force over (text bytes) in document order."""
    count, seen, out = collections.Counter(), set(), []
    for b in docs:
        count.update(b[i : i + width] for i in range(len(b) - width + 1))
    for b in docs:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if (w in seen) if keep_first else count[w] > 1:
                gone[i : i + width] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def by_words(docs, width):
    seen, out = set(), []
    for b in docs:
        ws, gone = b.split(), set()
        for i in range(len(ws) - width + 1):
            w = tuple(ws[i : i + width])
            if w in seen:
                gone.update(range(i, i + width))
            seen.add(w)
        out.append((len(ws), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(ws) if i not in gone)).hexdigest()))
    return out


def in_order(docs):
    rows = [(r["__r"], r["doc_id"], (r["text"] or "").encode()) for r in identified(docs, "__r").select("__r", "doc_id", "text").collect()]
    return sorted(rows, key=lambda r: (r[1] is None, r[1], r[0]))


@pytest.mark.parametrize("hot", [windows.HOT, 300])
@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("table", ["odd", "repeated"])
def test_bytes_equal_brute_force(request, table, keep_first, hot):
    docs = request.getfixturevalue(table)
    rows = in_order(docs)
    got = {r["rid"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup_bytes(docs, 200, keep_first=keep_first, hot=hot).collect()}
    assert [got[r[0]] for r in rows] == by_bytes([r[2] for r in rows], 200, keep_first)


@pytest.mark.parametrize("hot", [windows.HOT, 100])
@pytest.mark.parametrize("table", ["odd", "repeated"])
def test_words_equal_brute_force(request, table, hot):
    docs = request.getfixturevalue(table)
    rows = in_order(docs)
    got = {r["rid"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup_words(docs, 20, hot=hot).collect()}
    assert [got[r[0]] for r in rows] == by_words([r[2] for r in rows], 20)


def test_short_windows(odd):
    rows = in_order(odd)
    got = {r["rid"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup_words(odd, 2, gram=1).collect()}
    assert [got[r[0]] for r in rows] == by_words([r[2] for r in rows], 2)


def test_texts_keep_their_first_copy_and_other_columns(odd):
    cut = suffix_dedup.dedup_texts(odd)
    assert cut.columns == odd.columns
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    before = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert texts[0] is None and texts[7] == before[7] and texts[8] == ""


def test_kept_words(odd):
    texts = {r["doc_id"]: r["kept_text"] for r in substring_dedup.dedup_words(odd, keep_text=True).collect()}
    assert texts[8] == "" and texts[5] == "One two three"


def test_empty_table(empty):
    assert suffix_dedup.dedup_bytes(empty).count() == 0 and substring_dedup.dedup_words(empty).count() == 0 and suffix_dedup.dedup_texts(empty).count() == 0


def test_slices_of_a_long_text_agree(monkeypatch):
    rng = np.random.default_rng(0)
    text = rng.integers(97, 100, 5000).astype(np.uint8).tobytes()
    whole = [s for _, v, b in windows.slices([(0, text)], False, 50) for s in [windows.segments(v, b, 50, 10)]]
    monkeypatch.setattr(windows, "CHUNK", 700)
    starts = []
    for tags, values, bounds in windows.slices([(0, text)], False, 50):
        _, key, _, first, count, _ = windows.segments(values, bounds, 50, 10)
        starts += [(p + tags[0][1] + i, k) for k, p, c in zip(key, first, count) for i in range(c)]
    assert sorted(starts) == [(p + i, k) for _, key, _, first, count, _ in whole for k, p, c in zip(key, first, count) for i in range(c)]


def test_ranks_follow_suffix_order():
    data = np.frombuffer(b"banana$banana", np.uint8)
    ranks = windows.grow_ranks(data.astype(np.uint64), 3)
    order = sorted((i for i in range(len(ranks)) if ranks[i]), key=lambda i: (ranks[i], i))
    assert [bytes(data[i : i + 3]) for i in order] == sorted(bytes(data[i : i + 3]) for i in order) and len(order) == 8
