from gistmill.operators import sizing as S


def fnv(s):
    h = 0xCBF29CE484222325
    for c in s:
        h = ((h ^ ord(c)) * 0x100000001B3) % 2**64
    return h


def slow_fingerprint(text):
    t = text.lower()
    grams = [fnv(t[i : i + 4]) for i in range(max(1, len(t) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(g >> b & 1 for g in grams) > len(grams))


def test_fingerprint():
    for t in ("", "a", "abc", "abcd", "Hello World, this is it", "naïve façade €"):
        assert int(S.fingerprint(t)) == slow_fingerprint(t), t


def test_optimal_k():
    assert S.optimal_k(["a"] * 3) == 3 and S.optimal_k(["a"] * 8) == 8
    assert 3 <= S.optimal_k(["same line"] * 100) <= 5
    distinct = [f"{chr(97 + i % 26) * 6} {i * 7919} unique{i * i} words{i}" for i in range(50)]
    assert S.optimal_k(distinct) > 25
    assert 10 <= S.optimal_k(distinct, 1.0, 10, 20) <= 20


def test_knee_and_coverage():
    assert S.knee([0, 1, 2, 3, 4, 5]) is None and S.knee([0, 5, 9, 10, 10, 10, 10, 10]) <= 4 and S.knee([3, 3, 3]) == 1 and S.knee([1, 2]) is None
    c = S.coverage(["a b c", "a b", "x", "", "a b c d"])
    assert c == [2, 2, 3, 4, 5] and c == sorted(c)


def test_count_unique():
    assert S.count_unique(["request 1 done at node alpha"] * 5) == 1
    assert S.count_unique(["apples grow on trees", "zebra quantum physics", "1234567890"]) == 3
    assert S.count_unique([]) == 0


def test_curve_and_knee_in_sql(spark):
    items = ["a b c", "a b", "x", "", "a b c d", "q r s t u v", "a b", "a b", "a b", "a b"]
    df = spark.createDataFrame([(g, i, t) for g in (1, 2) for i, t in enumerate(items)], "g int, pos int, item string")
    curve = S.coverage_curve(df, "g", "pos", "item")
    assert [r["n"] for r in curve.where("g = 1").orderBy("pos").collect()] == S.coverage(items)
    assert {r["knee"] for r in S.knees(curve, "g", "pos", "n").collect()} == {S.knee(S.coverage(items))}


def slow_optimal_k(items, bias, least, most):
    """Counts all clusters, however many there are."""
    import math

    n, most = len(items), len(items) if most is None else most
    if n <= 8:
        return min(n, most)
    held = lambda k: max(least, min(k, most))
    leaders = []
    for f in (slow_fingerprint(x) for x in items):
        if all((f ^ x).bit_count() > 3 for x in leaders):
            leaders.append(f)
    unique = len(leaders)
    assert S.count_unique(items) == unique
    if unique <= 3:
        return held(max(least, unique))
    spread = max(least, math.floor(n * (0.3 + 0.7 * (unique / n))))
    bend = S.knee(S.coverage(items))
    bend = spread if bend is None else max(bend, spread) if unique / n > 0.7 else bend
    return held(max(least, math.floor(bend * bias)))


def test_optimal_k_by_full_count():
    import random

    random.seed(5)
    for n in (9, 30, 120):
        for kinds in (1, 2, 5, 40, 10**6):
            items = [f"request {random.randrange(kinds)} of user {random.randrange(kinds)} done" for _ in range(n)]
            for bias, least, most in ((1.0, 3, None), (0.76, 5, max(5, n // 3)), (1.2, 1, None)):
                assert S.optimal_k(items, bias, least, most) == slow_optimal_k(items, bias, least, most)


def test_many_fingerprints_at_once():
    import random

    random.seed(2)
    texts = ["".join(random.choice("abé😀 xyz") for _ in range(random.choice([0, 1, 3, 4, 5, 60, 255, 256, 300]))) for _ in range(400)]
    assert S.fingerprints(texts).tolist() == [slow_units(t) for t in texts]


def slow_units(text):
    units = [int.from_bytes(text.lower().encode("utf-16-le")[i : i + 2], "little") for i in range(0, 2 * len(text.lower().encode("utf-16-le")) // 2, 2)]
    return slow_fingerprint("".join(map(chr, units)))
