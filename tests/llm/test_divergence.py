"""op11 against exact Python integers, on small tables with every odd input."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import divergence

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows, least=3, top=200):
    """The contract, term by term."""
    docs = [(lang or "", source or "", TERM.findall(lowered(text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= least)
        counts = {s: Counter() for _, s, _ in own}
        for _, s, terms in own:
            counts[s].update(t for t in terms if t in set(kept))
        every = sum(counts.values(), Counter())

        def share(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(every)
        for s in counts:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def got(df, **kw):
    return sorted(tuple(r) for r in divergence.audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    words = [f"{a}{b}" for a in "abcdefghijklmno" for b in ("", "x", "É", "日")]
    weight = 1 / np.arange(1, len(words) + 1) ** 1.3
    out = []
    for i in range(60):
        picked = rng.choice(words, int(rng.integers(1, 60)), p=weight / weight.sum())
        out.append((i, " ".join(picked), ["en", "fr"][i % 2], f"s{i % 7 if i % 5 else 0}"))
    out += [(100, "Aa aA, AA\x00aa_aa1aa[aa", "en", "s1"), (101, None, "en", "s2"), (102, "", None, None), (103, "only here", "xx", "one"),
            (103, "only here", "xx", "one"), (104, "only here", "xx", "two"), (105, "1 2 3", "en", "no terms"), (106, None, "xx", "null text"),
            (None, "a ax", "en", "s0"), (107, "a " * 20_000, "en", "long")]
    out += [(200, out[1][1], "fr", "s1")] * 3
    return out


def test_audit_is_the_contract_in_plain_integers(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("n", "d", "term", "gid", "tile", "rank", "value", "item")})
    assert got(df) == plain(rows)
    assert got(df, least=1, top=3) == plain(rows, 1, 3)


def test_tiles_slots_and_single_words_agree(spark, rows, monkeypatch):
    """More than one tile of groups, small slots, and bitmaps taken word by word."""
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(divergence, "SLOT", 5)
    assert got(df) == plain(rows)
    monkeypatch.setattr(divergence, "TILE", 3)
    assert got(df) == plain(rows)


def test_word_by_word_equals_a_slot_at_a_time():
    rng = np.random.default_rng(4)
    whole = {0: 900, 1: 800, 2: 700}
    parts = {}
    for g in (0, 1):  # group 2 has no term of this slot
        n = rng.integers(0, 6, 200)
        for c in set(n.tolist()) - {0}:
            for t in np.flatnonzero(n == c):
                parts[g, c, t >> 6] = parts.get((g, c, t >> 6), 0) | 1 << int(t & 63)
    gid, n, word = (np.array([k[i] for k in parts], np.int64) for i in range(3))
    bits = np.array(list(parts.values()), np.uint64)
    once = divergence._Side(gid, n, word, bits, whole, 4)
    total = 0
    for w in range(4):
        at = word == w
        side = divergence._Side(gid[at], n[at], word[at] * 0, bits[at], whole, 1)
        total = total + divergence._between(side, side, min(200, 64 * w + 64) - 64 * w)
    assert (divergence._between(once, once, 200) == total).all()


def test_groups_of_a_language_without_kept_terms_have_pairs_of_value_0(spark):
    df = spark.createDataFrame([(1, "a", "en", "x"), (2, "b", "en", "y"), (3, None, "en", None)], SCHEMA)
    assert got(df) == plain([(1, "a", "en", "x"), (2, "b", "en", "y"), (3, None, "en", None)])
    assert {r[4] for r in got(df)} == {0} and len(got(df)) == 6


def test_shares_stay_exact_beyond_64_bits(spark):
    big = 5 * 10**12
    df = spark.createDataFrame([(big, 3 * big), (8_999_999_999, big), (9_000_000_000, big), (0, 1)], "c long, w long")
    found = [r[0] for r in df.select(divergence._share(F.col("c"), F.col("w"))).collect()]
    assert found == [1 + 10**9 * (c + 1) // w for c, w in [(big, 3 * big), (8_999_999_999, big), (9_000_000_000, big), (0, 1)]]


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
