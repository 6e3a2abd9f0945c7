"""Private values replaced by format-preserving pseudonyms, with DataFrame functions only.

A text is cut at candidate values. Each candidate is validated (checksums, calendar, octets, number plans); a valid one
goes through a keyed Feistel network over exactly the values of its format, so a card stays a card with a right check
digit, a date a date, and equal values stay equal in all documents. The permutation is one to one: whoever holds the
key can undo it, nobody else can.

Fixed by the formats: cards keep their first digit and get a new check digit; phone numbers keep the country code and
area and exchange codes of 100 to 999; addresses of four octets keep their shape only; dates stay within 1800-01-01 to
2199-12-31, four centuries of 146097 = 189 * 773 days; names in mail addresses and secret keys keep the class of each
character (letter case, digit), hexadecimal ones stay hexadecimal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from momentlake.llm.common import whole_text

ROUNDS = 8
#: One alternative per kind. Lookarounds keep a value from beginning or ending inside a longer one.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iso_date": r"(?<![0-9A-Za-z.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z-])",
    "day_date": r"(?<![0-9A-Za-z./-])[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}(?![0-9A-Za-z/-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|-[0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "access_key": r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "secret": r"(?i:(?<![a-z])(?:password|passwd|secret|token|api_?key))\s?[=:]\s?[\"']?[A-Za-z0-9_+/.-]{8,}",
}
ANY = "|".join(KINDS.values())


def mixed(key: str, tweak: Column, turn: Column, half: Column) -> Column:
    """64 hexadecimal digits that depend on key, format, round and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), half.cast("string")), 256)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _rounds(start: Column, left, right, end) -> Column:
    """Alternating rounds over a state of two halves; one expression for all rounds, the round number being data."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, lambda s, t: F.when(
        F.pmod(t, F.lit(2)) == 0, F.struct(left(s, t).alias("l"), s["r"].alias("r"))).otherwise(
        F.struct(s["l"].alias("l"), right(s, t).alias("r"))), end)


def feistel_number(x: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the numbers 0 to a * b - 1, as pairs of a number under ``a`` and one under ``b``."""
    def part(half, t):
        return F.conv(F.substring(mixed(key, tweak, t, half), 1, 15), 16, 10).cast("bigint")

    # exact for numbers over 2^53 too: the quotient is small, its error far under a half
    start = F.struct(F.round((x - F.pmod(x, b)) / b).cast("bigint").alias("l"), F.pmod(x, b).cast("bigint").alias("r"))
    return _rounds(start, lambda s, t: F.pmod(s["l"] + part(s["r"], t), a), lambda s, t: F.pmod(s["r"] + part(s["l"], t), b), lambda s: s["l"] * b + s["r"])


def feistel_string(x: Column, key: str, tweak: Column, hexadecimal: Column) -> Column:
    """A keyed permutation of strings that keeps length and the class of each character: A-Z, a-z (or a-f), 0-9; others stay.
    One half's characters are shifted by amounts that depend on the other half."""
    half = F.floor(F.length(x) / 2).cast("int")
    start = F.struct(F.substr(x, F.lit(1), half).alias("l"), F.substr(x, half + 1).alias("r"))
    return _rounds(start, lambda s, t: _shift(s["l"], mixed(key, tweak, t, s["r"]), hexadecimal), lambda s, t: _shift(s["r"], mixed(key, tweak, t, s["l"]), hexadecimal),
                   lambda s: F.concat(s["l"], s["r"]))


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _shift(text: Column, digits: Column, hexadecimal: Column) -> Column:
    letters = F.when(hexadecimal, 6).otherwise(26)

    def one(c, i, d):
        # two digits per place; from the 33rd place on they repeat, moved
        by = F.conv(F.substr(d, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 32).cast("int") * 7

        def turned(first, n):
            return F.chr(F.pmod(F.ascii(c) - F.lit(first) + by, n) + F.lit(first))

        return F.when(c.rlike("^[0-9]$"), turned(48, F.lit(10))).when(c.rlike("^[A-Z]$"), turned(65, letters)).when(c.rlike("^[a-z]$"), turned(97, letters)).otherwise(c)

    return _let(digits, lambda d: F.array_join(F.transform(chars(text), lambda c, i: one(c, i, d)), ""))


def put_over(shape: Column, plain: Column, place: str) -> Column:
    """``plain`` written over those characters of ``shape`` that match ``place``, whatever stands between."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    return F.aggregate(chars(shape), start, lambda acc, c: F.when(
        c.rlike(place), F.struct(F.concat(acc["out"], F.substr(plain, acc["n"] + 1, F.lit(1))).alias("out"), (acc["n"] + 1).alias("n")))
        .otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["n"].alias("n"))), lambda acc: acc["out"])


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Sum of the card checksum; ``doubled_last``: the last digit is one of those that are doubled."""
    def weigh(c, i):
        d = c.cast("int")
        return F.when(F.pmod(i, F.lit(2)) == F.lit(0 if doubled_last else 1), F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(chars(F.reverse(digits)), weigh), F.lit(0), lambda a, v: a + v)


def remainder_97(account: Column) -> Column:
    """Remainder of an account number by 97, letters read as 10 to 35."""
    wide = F.array_join(F.transform(chars(account), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    return F.aggregate(chars(wide), F.lit(0), lambda a, c: F.pmod(a * 10 + c.cast("int"), F.lit(97)))


def pad(x: Column, n) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def power10(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("bigint")


DAY_PATTERNS = ("dd/MM/yyyy", "dd.MM.yyyy", "MM/dd/yyyy")


def _kind(x: Column) -> Column:
    out = None
    for name, pattern in KINDS.items():
        whole = x.rlike("^(?:" + pattern + ")$")
        out = F.when(whole, name) if out is None else out.when(whole, name)
    return out


def _read(s: Column) -> Column:
    """What the permutations act on: ``num`` in 0 to a * b - 1, or ``txt``; both null where the value is not valid."""
    x, kind, d = s["x"], s["kind"], s["d"]
    n = F.length(d)
    part = lambda p, k: F.substr(d, F.lit(p), F.lit(k)).cast("bigint")
    is_ = lambda k: kind == k
    ten = F.substr(d, n - 9)
    area, exchange, line = (F.substr(ten, F.lit(p), F.lit(k)).cast("bigint") for p, k in ((1, 3), (4, 3), (7, 4)))
    phone = F.when((area >= 100) & (exchange >= 100), ((area - 100) * 900 + exchange - 100) * 10000 + line)
    place = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    ssn = F.when((part(1, 3) > 0) & (part(1, 3) < 900) & (part(1, 3) != 666) & (part(4, 2) > 0) & (part(6, 4) > 0), (place * 99 + part(4, 2) - 1) * 9999 + part(6, 4) - 1)
    octets = F.transform(F.split(x, r"\."), lambda o: o.cast("int"))
    ip = F.when(F.forall(octets, lambda o: o < 256), F.aggregate(octets, F.lit(0).cast("bigint"), lambda a, o: a * 256 + o))
    card = F.when((F.pmod(luhn_sum(d, False), F.lit(10)) == 0) & (F.length(F.replace(d, F.lit("0"), F.lit(""))) > 0), F.substr(d, F.lit(2), n - 2).cast("bigint"))
    day = F.datediff(F.when(is_("iso_date"), F.try_to_date(x, "yyyy-MM-dd")).otherwise(F.coalesce(*[F.try_to_date(x, p) for p in DAY_PATTERNS])), F.lit("1800-01-01").cast("date")).cast("bigint")
    day = F.when((day >= 0) & (day < 189 * 773), day)
    num = F.when(is_("card"), card).when(is_("phone"), phone).when(is_("ssn"), ssn).when(is_("ip"), ip).when(kind.isin("iso_date", "day_date"), day)
    low = F.floor((n - 2) / 2)
    a = F.when(is_("card"), power10(low)).when(is_("phone"), 90000).when(is_("ssn"), 898 * 99).when(is_("ip"), 65536).otherwise(189).cast("bigint")
    b = F.when(is_("card"), power10(n - 2 - low)).when(is_("phone"), 90000).when(is_("ssn"), 9999).when(is_("ip"), 65536).otherwise(773).cast("bigint")
    plain = F.replace(x, F.lit(" "), F.lit(""))
    iban = F.when(remainder_97(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))) == 1, F.substr(plain, F.lit(5)))
    head = F.when(is_("access_key"), "AKIA").when(is_("secret"), F.regexp_extract(x, r"^[A-Za-z_]+\s?[=:]\s?[\"']?", 0)).otherwise("")
    txt = F.when(is_("email"), F.get(F.split(x, "@"), F.lit(0))).when(is_("iban"), iban).when(kind.isin("access_key", "secret"), F.substr(x, F.length(head) + 1))
    return F.struct(x.alias("x"), kind.alias("kind"), d.alias("d"), head.alias("head"), num.alias("num"), a.alias("a"), b.alias("b"), txt.alias("txt"),
                    (is_("secret") & txt.rlike("^[0-9a-f]+$")).alias("hexa"))


def _permute(s: Column, key: str) -> Column:
    # cards of each length have a permutation of their own; a day is the same day in each notation
    tweak = F.when(s["kind"] == "card", F.concat(F.lit("card"), F.length(s["d"]).cast("string"))).when(s["kind"].isin("iso_date", "day_date"), "date").otherwise(s["kind"])
    num = F.when(s["num"].isNotNull(), feistel_number(s["num"], s["a"], s["b"], key, tweak))
    txt = F.when(s["txt"].isNotNull(), feistel_string(s["txt"], key, tweak, F.coalesce(s["hexa"], F.lit(False))))
    keep = [s[f].alias(f) for f in ("x", "kind", "d", "head")]
    return F.struct(*keep, num.alias("num"), txt.alias("txt"))


def _write(s: Column) -> Column:
    """``(kind, value)``; kind is null and the value unchanged where nothing was permuted."""
    x, kind, d, v, t = s["x"], s["kind"], s["d"], s["num"], s["txt"]
    is_ = lambda k: kind == k
    over = lambda k, n: F.pmod(F.floor(v / F.lit(k)), F.lit(n))
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), pad(v, F.length(d) - 2))
    card = _let(body, lambda c: F.concat(c, F.pmod(10 - F.pmod(luhn_sum(c, True), F.lit(10)), F.lit(10)).cast("string")))
    phone = F.concat(F.substr(d, F.lit(1), F.length(d) - 10), pad(over(9_000_000, 1000) + 100, 3), pad(over(10000, 900) + 100, 3), pad(F.pmod(v, F.lit(10000)), 4))
    area = over(99 * 9999, 1000)
    ssn = F.concat_ws("-", pad(F.when(area >= 665, area + 2).otherwise(area + 1), 3), pad(over(9999, 99) + 1, 2), pad(F.pmod(v, F.lit(9999)) + 1, 4))
    ip = F.concat_ws(".", *[F.pmod(F.shiftright(v, k), F.lit(256)).cast("string") for k in (24, 16, 8, 0)])
    day = F.date_add(F.lit("1800-01-01").cast("date"), v.cast("int"))
    pattern = [F.when(F.try_to_date(x, p).isNotNull(), F.date_format(day, p)) for p in DAY_PATTERNS]
    country = F.substr(x, F.lit(1), F.lit(2))
    iban = put_over(x, F.concat(country, pad(98 - remainder_97(F.concat(t, country, F.lit("00"))), 2), t), "[^ ]")
    by_number = F.when(kind.isin("card", "phone"), put_over(x, F.when(is_("card"), card).otherwise(phone), "[0-9]")).when(is_("ssn"), ssn).when(is_("ip"), ip).when(
        is_("iso_date"), F.date_format(day, "yyyy-MM-dd")).when(is_("day_date"), F.coalesce(*pattern))
    by_text = F.when(is_("email"), F.concat(t, F.lit("@"), F.get(F.split(x, "@"), F.lit(1)))).when(is_("iban"), iban).otherwise(F.concat(s["head"], t))
    value = F.when(v.isNotNull(), by_number).when(t.isNotNull(), by_text)
    return F.struct(F.when(v.isNotNull() | t.isNotNull(), kind).alias("kind"), F.coalesce(value, x).alias("value"))


def _each(values: Column, step) -> Column:
    return F.transform(values, lambda s: step(s))


def with_pseudonyms(docs: DataFrame, key: str, out: str, found: str) -> DataFrame:
    """Adds ``out``, the text with pseudonyms, and ``found``, an array of kinds replaced, to ``docs``."""
    t, c, n = (f"{found}_{x}" for x in "tcn")
    df = docs.withColumn(t, whole_text())
    # every text is searched: the kinds have no character in common that a text without values lacks
    df = df.withColumn(c, F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
    steps = F.transform(c, lambda x: F.struct(x.alias("x"), _kind(x).alias("kind"), F.regexp_replace(x, "[^0-9]", "").alias("d")))
    for step in (_read, lambda s: _permute(s, key), _write):
        steps = _each(steps, step)
    df = df.withColumn(n, F.when(F.size(c) > 0, steps))
    parts = F.split(t, ANY, -1)
    text = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(n, i)["value"], F.lit("")))), "")
    kinds = F.filter(F.transform(n, lambda x: x["kind"]), lambda k: k.isNotNull())
    return df.withColumns({out: F.when(F.size(n) > 0, text).otherwise(F.col("text")), found: F.coalesce(F.when(F.size(n) > 0, kinds), F.array().cast("array<string>"))}).drop(t, c, n)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, text, n_values`` and ``n_<kind>`` per row of ``docs`` (needs doc_id and text).

    Null texts stay null, empty ones empty; repeated rows are treated each; values that fail validation stay; other
    columns are not read; an empty table gives an empty result.
    """
    df = with_pseudonyms(docs.select("doc_id", "text"), key, "new_text", "found")
    counts = [_count(name) for name in KINDS]
    return df.select("doc_id", F.col("new_text").alias("text"), F.size("found").alias("n_values"), *counts)


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda k: k == kind)).alias(f"n_{kind}")


def replace_in_documents(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; all columns and rows are kept."""
    names = {c.lower() for c in docs.columns}
    out = "_pii"
    while any(x.startswith(out) for x in names):
        out = "_" + out
    df = with_pseudonyms(docs, key, out + "_text", out + "_found")
    return df.select(*[F.col(out + "_text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
