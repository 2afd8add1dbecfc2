import hashlib
import random

import pytest

from procweave.llm import fingerprints as fp
from procweave.llm.common import identified
from procweave.llm.windows import BASE, MIX
from tests.llm.conftest import words

FULL = (1 << 64) - 1


def mix(x):
    x ^= x >> 32
    x = x * MIX & FULL
    x ^= x >> 29
    x = x * BASE & FULL
    return x ^ x >> 32


def plain(data):
    """The fingerprint byte by byte with whole numbers."""
    padded = b"\0" * 6 + data
    hashes = [mix(int.from_bytes(padded[i : i + 7], "little") * BASE & FULL) for i in range(len(data))]
    level_of = lambda h: (~h & (h + 1)).bit_length() - 1
    level = max([k for k in range(48) if sum(level_of(h) >= k for h in hashes) >= 32], default=0)

    def signature(level):
        sums, total, size = [], 0, 0
        for h in hashes:
            total, size = (total + h) & FULL, size + 1
            if level_of(h) >= level:
                sums.append(total)
                total = size = 0
        if size:
            sums.append(total)
        if len(sums) > fp.LONGEST:
            sums[fp.LONGEST - 1 :] = [sum(sums[fp.LONGEST - 1 :]) & FULL]
        return "".join(chr(fp.ALPHABET[mix(s) >> 58]) for s in sums)

    return f"{level}:{signature(level)}:{signature(level + 1)}"


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


TEXTS = ["", "a", "Ünïcödé", "x" * 3000, "ab " * 700, words(random.Random(1), 5000, 10**6), words(random.Random(2), 40)]


@pytest.mark.parametrize("step", [1 << 20, 100])
def test_equal_to_byte_by_byte(monkeypatch, step):
    monkeypatch.setattr(fp, "STEP", step)
    for text in TEXTS:
        assert fp.fingerprint(text.encode()) == plain(text.encode())


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcde") for _ in range(rng.randrange(0, 90))) for _ in range(2))
        assert fp.common_length(a, b) == subsequence(a, b)


def test_likeness_follows_what_is_shared():
    rng = random.Random(5)
    for size in (20, 100, 1000, 20_000):
        text, strange = words(rng, size, 10**6), words(rng, size, 10**6)
        changed = text.split()
        changed[size // 2] = "CHANGED"
        one, half = fp.likeness(fp.fingerprint(text.encode()), fp.fingerprint(" ".join(changed).encode())), fp.likeness(fp.fingerprint(text.encode()), fp.fingerprint(fp.edited(text, strange).encode()))
        none = fp.likeness(fp.fingerprint(text.encode()), fp.fingerprint(strange.encode()))
        assert 0.8 < one <= 1 and 0.3 < half < one and none < 0.3
    assert fp.likeness("0::", "0::") == 1 and fp.likeness("0::", fp.fingerprint(b"abc")) == 0


def brute(rows):
    """rows in order of the next document: (id, text)."""
    out = []
    for n, (i, text) in enumerate(rows):
        text, after = text or "", rows[(n + 1) % len(rows)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        a, b, c = (plain(t.encode()) for t in (text, changed, after))
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("table", ["odd", "repeated"])
def test_edit_test_equals_brute_force(request, table):
    docs = request.getfixturevalue(table).filter("text IS NULL OR length(text) < 50000")
    rows = sorted(((r["r_"], r["doc_id"], r["text"]) for r in identified(docs, "r_").select("r_", "doc_id", "text").collect()), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    got = [(r["doc_id"], *(r[c] for c in fp.FOUND)) for r in fp.edit_test(docs).collect()]
    assert sorted(got, key=repr) == brute([r[1:] for r in rows])


def test_few_rows(spark, empty, write):
    assert fp.edit_test(empty).count() == 0
    one = fp.edit_test(write([(7, "abcdef", "en", "s")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one["near_next"] == 1
    marks = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(write([(i, t, "en", "s") for i, t in enumerate([*TEXTS[:4], *TEXTS[:4]])])).collect()}
    assert all(marks[i] == marks[i + 4] == fp.fingerprint(TEXTS[i].encode()) for i in range(4))
