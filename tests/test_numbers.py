"""Numbers in templates against Python's."""

import random

from weftline.functions.template import Compiler


def test_floats_are_shown_as_python_shows_them(spark):
    r = random.Random(5)
    held = [0.0, -0.0, 1e7, -1e7, 12345678.0, 123456789.25, 1e15, 1e16, 1.5e16, -1.5e22, 1e100, 0.001, 0.0001, 0.00012, 1e-5, -1.5e-7, 1e-300, 9999999.5, float("inf"), float("-inf"), float("nan")]
    held += [float(r.randrange(10**k)) for k in range(1, 16) for _ in range(20)] + [round(r.uniform(-1e9, 1e9), 2) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(held)), "i int, x double")
    c = Compiler(df.schema)
    rows = df.orderBy("i").select(c.render("{{ x }}"), c.render("{{ [x, 0.5] }}"), c.render("{{ [x, 0.5]|join(';') }}"), c.render("{{ x|string }}")).collect()
    assert [tuple(row) for row in rows] == [(str(x), f"[{x}, 0.5]", f"{x};0.5", str(x)) for x in held]
    whole = spark.createDataFrame([(10_000_000,), (600_014_999,)], "k bigint")
    assert [row[0] for row in whole.select(Compiler(whole.schema).render("{{ k|float }}")).collect()] == ["10000000.0", "600014999.0"]


def test_whole_numbers_are_exact(spark):
    pairs = [(100_000_001, 2), (3_037_000_499, 2), (3_037_000_500, 2), (-3, 3), (-3, 40), (3, 39), (3, 40), (7, 0), (0, 0), (0, 5), (1, 10**12), (-1, 10**12 + 1), (-1, 64), (2, 62), (2, 63), (-2, 63), (-2, 64), (2, 64), (2, 65), (2, 66), (5, -1), (2**62 + 1, 7), (-(2**62) - 1, 7), (2**53 + 1, -2), (-(2**63), -1), (-(2**63), 1), (-(2**63), 3), (2**63 - 1, -(2**63)), (-7, 3), (7, -3), (-6, 3), (9, 0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x bigint, y bigint")
    c = Compiler(df.schema)
    rows = df.orderBy("i").select(c.render("{{ x ** y }}"), c.render("{{ x // y }}"), c.render("{{ x % y }}"), c.render("{{ x ** 2 }}")).collect()
    fits = lambda n: str(n) if -(2**63) <= n < 2**63 else None
    power = lambda x, y: None if y < 0 or abs(x) > 1 and y > 64 else fits(x**y if y < 99 else x ** (y % 2 + 2))
    assert [tuple(r) for r in rows] == [(power(x, y), fits(x // y) if y else None, str(x % y) if y else None, fits(x**2)) for x, y in pairs]
