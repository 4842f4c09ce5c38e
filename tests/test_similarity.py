"""Similarity joins against all pairs, and the resolution of names against its passes one after the other."""

import random

import pandas as pd
import pytest

from monthloom.functions import fuzzy
from monthloom.operators import joins as J


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(max(row[-1], last[j + 1], last[j] + (x == y)))
    return row[-1]


def plain_ratio(a, b):
    return 200.0 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def plain_set_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, one, two = (sorted(s) for s in (x & y, x - y, y - x))
    whole = " ".join(both + one), " ".join(both + two)
    if both and " ".join(both) in whole:
        return 100.0
    return max(plain_ratio(*whole), *[plain_ratio(" ".join(both), w) if both else 0 for w in whole])


def names(rng, n, letters="abcdefgh"):
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(25)]
    out = []
    for _ in range(n):
        s = list(" ".join(rng.sample(words, rng.randrange(1, 4))))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(s) + 1)
            s[i : i + rng.randrange(2)] = rng.choice(["", rng.choice(letters), " "])
        out.append("".join(s))
    return out


def test_lengths_of_subsequences():
    rng = random.Random(1)
    a = ["".join(rng.choice("abcd é") for _ in range(rng.choice([0, 1, 5, 20, 63, 64]))) for _ in range(200)]
    b = ["".join(rng.choice("abcd é") for _ in range(rng.choice([0, 1, 5, 20, 64, 90]))) for _ in range(200)]
    assert fuzzy.lcs_lengths(a, b).tolist() == [plain_lcs(x, y) for x, y in zip(a, b)]
    assert fuzzy.lcs_lengths(["x" * 100], ["xy" * 70]).tolist() == [plain_lcs("x" * 100, "xy" * 70)]
    assert all(m >= plain_lcs(x, y) for m, x, y in zip(fuzzy.most_in_common(a, b), a, b))
    got = fuzzy.ratios(pd.Series(["", None, "ab", "ab"]), pd.Series(["", "a", "ba", "cd"]), 50.0)
    assert got[0] == 100 and got[2] == 50 and got.isna().tolist() == [False, True, False, True]


@pytest.mark.parametrize("cutoff,letters", [(85.0, "abcdefgh"), (85.0, "ab"), (70.0, "abcd"), (92.5, "abc")])
def test_similar_pairs_miss_none(spark, cutoff, letters):
    rng = random.Random(cutoff + len(letters))
    left, right = ([" ".join(x.split()) for x in names(rng, 250, letters)] for _ in "ab")
    right += [x[1:] + x[:1] for x in left[:60]] + ["a", "ab", "b"]
    a, b = spark.createDataFrame([(x,) for x in left], "x string"), spark.createDataFrame([(x,) for x in right], "y string")
    met = {tuple(r) for r in J.similar_pairs(a, b, "x", "y", cutoff).collect()}
    want = {(x, y) for x in set(left) for y in set(right) if x and y and plain_ratio(x, y) >= cutoff}
    assert want <= met and len(want) > 20


@pytest.mark.parametrize("scorer,score", [("sort", plain_ratio), ("set", plain_set_ratio)])
def test_best_equals_all_pairs(spark, scorer, score):
    rng = random.Random(9)
    left, right = names(rng, 150), names(rng, 150)
    left += [" ".join(rng.sample(x.split(), len(x.split()))) + rng.choice(["", " b", "x"]) for x in right[:60]]
    tokens = lambda s: " ".join(sorted(s.split()))
    got = {r["name"]: (r["choice"], r["score"]) for r in J.fuzzy_best(spark.createDataFrame([(x,) for x in left], "name string"), spark.createDataFrame([(x,) for x in right], "choice string"), "name", "choice", 85.0, scorer).collect()}
    some = 0
    for x in set(left):
        best = min(((-score(tokens(x), tokens(y)), y) for y in set(right) if tokens(x) and tokens(y)), default=(0, None))
        if -best[0] >= 85:
            some += 1
            assert got[x][0] == best[1] and got[x][1] == pytest.approx(-best[0])
        else:
            assert got[x] == (None, None)
    assert some > 40


def test_first_alias_decides(spark):
    names_ = spark.createDataFrame([("Foo (old) 5 mg",), ("Bar",), ("baz hydrochloride",), (None,), ("Qux plus",)], "name string")
    panel = spark.createDataFrame([("Foo", "TABLET"), ("new foo", "TABLET"), ("bar", "TABLET"), ("Baz", "INJECTION"), ("qux plus drug", "x"), ("qux drug and other", "x")], "target string, form string")
    aliases = spark.createDataFrame([("foo", "gone"), ("foo (old)", "new foo"), ("bar", "nothing"), ("bar 5", "bar")], "alias string, target string")
    got = {r["name"]: (r["target"], r["pass_no"]) for r in J.match_names(names_, panel, aliases).collect()}
    assert got == {"Foo (old) 5 mg": ("new foo", 1), "Bar": ("bar", 2), "baz hydrochloride": ("Baz", 7), "Qux plus": ("qux plus drug", 6)}
