"""Personal data: candidate gradient boosting, in SQL functions only.

Base spans (email, ip, card, phone) follow fixed patterns and checks and always
stay. For further kinds, high-recall generators propose spans that may overlap;
boosted trees score each from its format and the text before it; a threshold
per kind, calibrated for precision on examples held out, selects; of selected
spans that overlap, the leftmost stays (at one start, the kind listed first).

The trees are fitted on the driver on `TRAIN_ROWS` invented examples that pass
through the same generator and feature expressions, and the thresholds calibrated
on others of these and on `_pii_cases`, which were written apart from them; the
text path itself has no Python. Work per text is linear in its length and in its spans, and there is no
shuffle, so neither a hot source nor groups of copies matter.

Defined results: a null or empty text has no spans; a null doc_id stays null;
repeated rows give repeated results; an empty table gives no rows; other columns
pass through, one called like the result of `detect` under another name.
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _gbt
from ._pii_cases import CASES
from ._common import table, unused

TRAIN_ROWS = 2400
PRECISION = 0.98

#: kind: (pattern, test that every text with a match passes, run before the pattern). Start conditions and possessive
#: quantifiers keep every pattern linear without changing its leftmost matches.
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "t RLIKE r'[0-9]\\.[0-9]'"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+", "t RLIKE r'[0-9][0-9\\x20-]{11}'"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains(t, '+')"),
}
EXTRA = {
    "secret": (r"(?i)(?<![A-Za-z])(?:access|api|auth|private|client)?[_-]?(?:token|secret|key|password|passwd|pwd)[\x22\x27]?\s{0,3}[=:]\s{0,3}[\x22\x27]?[A-Za-z0-9+/_-]{8,}+={0,2}", "t RLIKE r'[=:]'"),
    "token": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+", "t RLIKE r'[A-Za-z0-9+/_-]{20}'"),
    "phone_local": (r"(?<![0-9+.(-])(?<!\+[0-9]{1,3}[\x20.-])\(?[0-9]{3}\)?[\x20.-]\(?[0-9]{3}\)?[\x20.-][0-9]{4}(?![0-9])", "t RLIKE r'[0-9]{3}\\)?[\\x20.-]\\(?[0-9]'"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "t RLIKE r'[0-9]-[0-9]{2}-[0-9]'"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "t RLIKE r'[A-Z]{2}[0-9]{2}'"),
    "email_spelled": (r"(?i)[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++", "t RLIKE r'(?i)[\\[(]at[\\])]'"),
}
KINDS = [*BASE, *EXTRA]
SPAN = "struct<start:int,ord:int,end:int,kind:string,value:string,before:string>"
_DIGITS = "regexp_replace({}, '[^0-9]', '')"
#: Luhn sum over the reversed digits; every second one counts double, less 9 above 9.
_LUHN = "aggregate(transform(split(reverse({d}), ''), (c, i) -> IF(i % 2 = 0, int(c), IF(int(c) > 4, 2 * int(c) - 9, 2 * int(c)))), 0, (a, c) -> a + c) % 10 = 0"
_VALID = f"""CASE x.kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN forall(split(x.value, '[.]'), p -> coalesce(try_cast(concat('0', ltrim('0', p)) AS DECIMAL(38, 0)) <= 255, false))
  WHEN 'card' THEN length({_DIGITS.format("x.value")}) <= 19 AND {_LUHN.format(d=_DIGITS.format("x.value"))}
  ELSE length({_DIGITS.format("x.value")}) BETWEEN 9 AND 15 END"""
_BEFORE = "lower(concat(y.before, y.value))"
FEATURES = {
    **{f"is_{k}": f"IF(y.kind = '{k}', 1D, 0D)" for k in EXTRA},
    "length": "double(length(y.value))",
    "digits": "length(regexp_replace(y.value, '[^0-9]', '')) / double(length(y.value))",
    "upper": "length(regexp_replace(y.value, '[^A-Z]', '')) / double(length(y.value))",
    "vowels": "length(regexp_replace(y.value, '[^aeiouAEIOU]', '')) / double(length(y.value))",
    "marks": "length(regexp_replace(y.value, '[A-Za-z0-9]', '')) / double(length(y.value))",
    "changes": "size(regexp_extract_all(y.value, '[0-9][A-Za-z]|[A-Za-z][0-9]', 0)) / double(length(y.value))",
    "variety": "double(size(array_distinct(split(y.value, ''))))",
    "says_secret": f"IF({_BEFORE} RLIKE 'token|secret|key|passw|pwd|auth', 1D, 0D)",
    "says_phone": f"IF({_BEFORE} RLIKE 'tel|phone|call|fax|mobile|dial', 1D, 0D)",
    "says_person": f"IF({_BEFORE} RLIKE 'ssn|social|security|iban|account|bank|mail|contact', 1D, 0D)",
    "says_stock": f"IF({_BEFORE} RLIKE 'order|part|item|version|invoice|ref|sum|row|isbn', 1D, 0D)",
    "quoted": "IF(y.before RLIKE '[\\x22\\x27=:]\\\\s?$', 1D, 0D)",
}


#: Items that a fold appends one by one before its state is taken up again, and items of a wider division of the same.
STEP, WIDE = 64, 4096


def _let(name: str, value: str, body: str) -> str:
    """SQL: `body` with `name` bound to the value, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _scan(items: str, kind: str, start: str, after: str, some: str, made: str) -> str:
    """SQL: in order, for each x of the array `items` with the state p before it, `made` (of type `kind`) where `some` holds.

    p begins as `start` and becomes `after`. Appending to an array copies it, so one fold keeps only the state at each
    `STEP`th item, and from each of these states a fold of its own appends: the work is linear in the items."""
    x = lambda sql, i: _let("x", f"n[{i}]", sql)
    states = f"""aggregate(sequence(0, size(n) - 1), named_struct('p', {start}, 'at', CAST(array() AS array<int>)),
      (a, i) -> {_let("p", "a.p", f"named_struct('p', {x(after, 'i')}, 'at', IF(i % {STEP} = 0, concat(a.at, array(p)), a.at))")}, a -> a.at)"""
    block = f"""aggregate(sequence(k * {STEP}, least(k * {STEP} + {STEP - 1}, size(n) - 1)), named_struct('p', q, 'out', CAST(array() AS array<{kind}>)),
      (a, i) -> {_let("p", "a.p", x(f"named_struct('p', {after}, 'out', IF({some}, concat(a.out, array({made})), a.out))", "i"))}, a -> a.out)"""
    return _let("n", items, f"CASE WHEN size(n) > 0 THEN flatten(transform({states}, (q, k) -> {block})) ELSE CAST(array() AS array<{kind}>) END")


def _found(kind: str, ord_: int, pattern: str, guard: str) -> str:
    """SQL: the spans of one kind in column t. Gaps between matches give the positions in code points."""
    p = f"r'{pattern}'"
    # of an assignment, the span is the value alone
    value = "regexp_extract(x.m, '[A-Za-z0-9+/_-]{8,}={0,2}$', 0)" if kind == "secret" else "x.m"
    end = "p + length(x.g) + length(x.m)"
    span = f"named_struct('start', {end} - length({value}), 'ord', {ord_}, 'end', {end}, 'kind', '{kind}', 'value', {value}, 'before', concat(right(x.g, 24), left(x.m, length(x.m) - length({value}))))"
    pairs = f"zip_with(split(t, {p}, -1), regexp_extract_all(t, {p}, 0), (g, m) -> named_struct('g', g, 'm', m))"
    return f"""CASE WHEN {guard} THEN {_scan(pairs, SPAN, "0", "p + length(x.g) + coalesce(length(x.m), 0)", "x.m IS NOT NULL", span)} ELSE CAST(array() AS array<{SPAN}>) END"""


def _all(kinds: dict, first: int) -> str:
    return f"concat({', '.join(_found(k, first + i, *v) for i, (k, v) in enumerate(kinds.items()))})"


def _invented(rows: int = TRAIN_ROWS, seed: int = 11) -> list[tuple[str, int]]:
    """(text with one candidate, label): formats of personal data and look-alikes, each in and out of telling context."""
    r = random.Random(seed)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    word = lambda a=2, b=9: pick(string.ascii_lowercase[:20] + "aeiou" * 3, r.randint(a, b))
    hexed, mixed = "0123456789abcdef", string.ascii_letters + string.digits
    local = lambda: r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(pick(string.digits, 3), pick(string.digits, 3), pick(string.digits, 4))
    names = ["token", "api_key", "secret", "password", "auth-token", "client_secret", "passwd", "key"]
    assign = lambda v: r.choice(['{} = "{}"', "{}={}", "{}: {}", "'{}': '{}'"]).format(r.choice(names), v)
    yes = [
        lambda: assign(pick(hexed, r.randint(12, 48))), lambda: assign(pick(mixed, r.randint(12, 48))), lambda: assign(r.choice(["sk_live_", "ghp_"]) + pick(mixed, 30)),
        lambda: r.choice(["ghp_", "AKIA", "xoxb-", ""]) + pick(mixed + "0123456789", r.randint(24, 50)), lambda: pick(hexed, r.choice([32, 40, 64])),
        lambda: r.choice(["tel ", "phone: ", "call me at ", "fax ", "", ""]) + local(),
        lambda: r.choice(["ssn ", "SSN: ", "social security number ", ""]) + f"{pick(string.digits, 3)}-{pick(string.digits, 2)}-{pick(string.digits, 4)}",
        lambda: r.choice(["IBAN ", "account ", "", "bank "]) + pick(string.ascii_uppercase, 2) + pick(string.digits, 2) + "".join(r.choice(["", " "]) + pick(string.digits, 4) for _ in range(r.randint(3, 6))),
        lambda: f"{word()}.{word()} {r.choice(['(at)', '[at]'])} {word()} {r.choice(['[dot]', '(dot)'])} {r.choice(['com', 'org', 'de'])}", lambda: f"{word()}{pick(string.digits, 2)}[at]{word()}.com",
    ]
    no = [
        lambda: assign(word(8, 14)), lambda: assign("_".join(word(4, 8) for _ in range(3))), lambda: f"the {r.choice(names)}: {word(8, 12)} {word()}",
        lambda: "/".join(word(4, 9) for _ in range(5)) + r.choice(["", "/v2", "/2024"]), lambda: r.choice("-_=a0") * r.randint(20, 40), lambda: word(22, 34), lambda: "-".join(word(4, 9) for _ in range(5)) + r.choice(["", "-2024", "-7"]),
        lambda: "_".join(word(3, 7) for _ in range(4)) + pick(string.digits, 1), lambda: pick(string.digits, r.randint(20, 30)),
        lambda: r.choice(["sum ", "order ", "part ", "row ", "invoice ", "version "]) + local(),
        lambda: r.choice(["order ", "part ", "item ", "ref ", "isbn "]) + f"{pick(string.digits, 3)}-{pick(string.digits, 2)}-{pick(string.digits, 4)}",
        lambda: pick(string.ascii_uppercase, 2) + pick(string.digits, 2) + "".join(" " + pick(string.ascii_uppercase, 4) for _ in range(4)),
        lambda: f"{word()} (at) {word()}. {word().title()} {word()}",
    ]
    out = []
    for i in range(rows):
        kinds, label = (yes, 1) if i % 2 else (no, 0)
        text = f"{' '.join(word() for _ in range(r.randint(0, 5)))} {r.choice(kinds)()} {word()}".replace("'", "\x22")
        out.append((text, label))
    return out


def _candidates(df: DataFrame) -> DataFrame:
    """`c`: candidates of `df.t` with their features as an array of doubles."""
    features = ", ".join(FEATURES.values())
    return df.withColumn("c0", F.expr(_all(EXTRA, len(BASE)))).withColumn("c", F.expr(f"transform(c0, y -> named_struct('s', y, 'f', array({features})))")).drop("c0")


def _measured(spark: SparkSession, cases: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(case, kind, label, features) of every candidate that the generators find in the cases."""
    rows = ", ".join("({}, '{}', {})".format(i, t.replace("\\", "\\\\").replace("'", "\\'"), y) for i, (t, y) in enumerate(cases))
    found = _candidates(spark.sql(f"SELECT * FROM VALUES {rows} AS v(i, t, y)")).select("i", "y", F.explode("c").alias("c"))
    got = found.select("i", "c.s.kind", "y", "c.f").collect()  # bounded by the cases
    return tuple(np.array([r[k] for r in got]) for k in range(4))


def fit(spark: SparkSession, rows: int = TRAIN_ROWS) -> tuple[_gbt.Forest, dict[str, float]]:
    """The forest, fitted on three quarters of `rows` invented examples, and the threshold of each further kind: the least
    at which both the last quarter and the lines written by hand reach `PRECISION`, the greatest if none does."""
    i, kind, y, x = _measured(spark, _invented(rows))
    own = i // 2 % 4 > 0  # both labels alternate
    forest = _gbt.fit(x[own], y[own], trees=24, depth=3, rate=0.3, bins=24)
    _, kind_, y_, x_ = _measured(spark, CASES)
    sets, thresholds = [(kind[~own], y[~own], forest.probability(x[~own])), (kind_, y_, forest.probability(x_))], {}
    for k in EXTRA:
        sure = lambda t: all((y[hit].mean() if (hit := (kind == k) & (p >= t)).any() else 1.0) >= PRECISION for kind, y, p in sets)  # noqa: B023, E731
        thresholds[k] = round(float(min([t for t in np.arange(0.5, 0.99, 0.02) if sure(t)], default=0.98)), 2)
    return forest, thresholds


def _spans(found: DataFrame, model: tuple[_gbt.Forest, dict[str, float]]) -> DataFrame:
    """`found` (with the text as t) with the arrays `base` and `added` of spans, each sorted."""
    forest, thresholds = model
    score = forest.sql([f"z.f[{i}]" for i in range(len(FEATURES))])
    least = " ".join(f"WHEN '{k}' THEN {v}D" for k, v in thresholds.items())
    found = _candidates(found.withColumn("b", F.expr(_all(BASE, 0))))
    chosen = f"array_sort(transform(filter(c, z -> {score} >= CASE z.s.kind {least} END), z -> z.s))"
    apart = _scan(chosen, SPAN, "0", "IF(x.start >= p, x.end, p)", "x.start >= p", "x")
    return found.withColumn("base", F.expr(f"array_sort(filter(b, x -> {_VALID}))")).withColumn("added", F.expr(apart)).drop("b", "c")


def _own(df: DataFrame, text: str) -> DataFrame:
    """The row as a struct beside its text, so that names of its columns clash with none."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), F.coalesce(df[f"`{text}`"].cast("string"), F.lit("")).alias("t"))


def detect(df: DataFrame, text: str = "text", model: tuple[_gbt.Forest, dict[str, float]] | None = None, out: str = "pii") -> DataFrame:
    """`df` with `out`: struct<base, added>, arrays of spans (start, ord, end, kind, value, before), sorted."""
    found = _spans(_own(df, text), model or fit(df.sparkSession))
    names = [unused(df, f"{c}_before") if c.lower() == out.lower() else c for c in df.columns]
    return found.select(*[F.col(f"row.`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)], F.struct("base", "added").alias(out))


def redact(df: DataFrame, text: str = "text", model: tuple | None = None) -> DataFrame:
    """`df` with every span of `text` replaced by its kind in angle brackets; overlapping spans are replaced as one, by the
    kind of the first. Null stays null. The text is cut into parts of `WIDE` and these of `STEP` replacements first, as
    a cut's cost grows with its place."""
    seen = _spans(_own(df, text), model or fit(df.sparkSession))
    kept = _scan("array_sort(concat(base, added))", "struct<p:int,start:int,end:int,kind:string>", "0", "greatest(p, x.end)", "x.start >= p", "named_struct('p', p, 'start', x.start, 'end', x.end, 'kind', x.kind)")
    upto = lambda i, n: f"least({i} * {n} + {n - 1}, size(e) - 1)"
    one = "concat(substring(v, e[j].p - e[i * {s}].p + 1, e[j].start - e[j].p), '<', upper(e[j].kind), '>')".format(s=STEP)
    part = _let("v", f"substring(u, e[i * {STEP}].p - e[h * {WIDE}].p + 1, e[{upto('i', STEP)}].start - e[i * {STEP}].p)", f"array_join(transform(sequence(i * {STEP}, {upto('i', STEP)}), j -> {one}), '')")
    wide = _let("u", f"substring(t, e[h * {WIDE}].p + 1, e[{upto('h', WIDE)}].start - e[h * {WIDE}].p)", f"array_join(transform(sequence(h * {WIDE // STEP}, least(h * {WIDE // STEP} + {WIDE // STEP - 1}, (size(e) - 1) div {STEP})), i -> {part}), '')")
    # the state before a replacement is where the one before it ended, as each starts a run of overlapping spans
    whole = _let("e", kept, f"concat(array_join(transform(sequence(0, (size(e) - 1) div {WIDE}), h -> {wide}), ''), substring(t, last + 1))")
    seen = seen.withColumn("last", F.expr("array_max(transform(concat(base, added), x -> x.end))"))
    clean = seen.select("row", F.when(F.size("base") + F.size("added") > 0, F.expr(whole)).otherwise(F.col(f"row.`{text}`").cast("string")).alias("t"))
    return clean.select(*[F.col("t").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = detect(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    joined = lambda a: f"array_join(transform({a}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    return seen.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(pii.base, x -> x.kind = '{k}')) AS long)").alias(f"n_{k}") for k in BASE],
        F.expr(f"sha2({joined('pii.base')}, 256)").alias("base_sha256"),
        F.expr(joined("array_sort(concat(pii.base, pii.added))")).alias("spans"),
    )
