"""Format-preserving pseudonyms by keyed Feistel networks, as DataFrame expressions.

Cards (Luhn), social security numbers, phone numbers, IPv4 addresses, dates and e-mail names are found,
checked, and replaced by another valid value of the same format.  Formats are looked for in turn, each
where no valid value was found yet, so that a number next to a value does not hide it: first those with
marks of their own, then cards in usual groups anywhere in a row of numbers, phone numbers, and last
rows of numbers that are a card as a whole.  The map is a keyed
permutation of the values of a format: equal values get equal pseudonyms in every document, different
ones different pseudonyms.  It is ``F``, one step around a cycle, then ``F`` backwards, where ``F`` is
a Feistel network with SHA-256 rounds; a permutation of this shape has no fixed point, so no value
stays what it was.  Texts without matches are left alone, and so are numbers that fail their check.

Null texts stay null, null ids and other columns are carried along, an empty table gives an empty one.
"""

from __future__ import annotations

from secrets import token_hex

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let
from .spans import match_spans

ROUNDS = 8
# The formats that are looked for, in order of precedence.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IPV4 = r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\w)"
PHONE = r"(?<!\w)\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
DATE = r"(?<![\w./-])(?:\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\w/-]|\.\d)"
CARD = r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"
#: Formats that no other number can be part of; what directly follows a country code is a phone number.
MARKED = "|".join(f"(?:{p})" for p in (EMAIL, IPV4, *(rf"(?<!\+\d{{1,3}}[ .-])(?:{p})" for p in (SSN, DATE))))
#: Rows of numbers with enough digits, as long as they go; a last character that is no digit spoils the last number.
ROW = r"(?<![\w+-])(?=\d(?:[ -]?\d){12})\d++(?:[ -]\d++)*+[\w-]?"
NUMBER = r"\d++(?!\w|-$)"
ROW_GATE = r"\d(?:[ -]?\d){12}"
#: Sizes of the groups of a card that is not written in one.  Short ones first: what follows a card may be its security code.
GROUPS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 1), (4, 4, 4, 4, 2), (4, 4, 4, 4, 3))
GATE = "[@0-9]"
KINDS = ("email", "ipv4", "phone", "ssn", "date", "card")
FIRST_DAY, DAYS = "1900-01-01", 73_049  # to 2099-12-31; 73,049 = 17 * 4,297


def _hash_number(key: str, tweak: str, i: Column, value: Column) -> Column:
    raw = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(raw, 1, 15), 16, 10).cast("bigint")


def permute_number(left: Column, right: Column, n_left, n_right, key: str, tweak: str) -> Column:
    """Struct ``l, r`` of the permuted pair in ``[0, n_left) x [0, n_right)``; never the pair itself."""
    n_left, n_right = (F.lit(n).cast("bigint") if isinstance(n, int) else n for n in (n_left, n_right))

    def rounds(start: Column, sign: int) -> Column:
        def step(acc: Column, i: Column) -> Column:
            even = i % 2 == 0
            l = F.when(even, F.pmod(acc["l"] + sign * F.pmod(_hash_number(key, tweak, i, acc["r"]), n_left), n_left)).otherwise(acc["l"])
            r = F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + sign * F.pmod(_hash_number(key, tweak, i, acc["l"]), n_right), n_right))
            return F.struct(l.alias("l"), r.alias("r"))

        order = list(range(ROUNDS)) if sign > 0 else list(range(ROUNDS))[::-1]
        return F.aggregate(F.array(*[F.lit(i) for i in order]), start, step)

    pair = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    turn = lambda p: F.struct(p["l"].alias("l"), F.pmod(p["r"] + 1, n_right).alias("r"))
    return let(rounds(pair, 1), lambda p: rounds(turn(p), -1))


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """Another string of as many digits (1 to 18)."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    size = lambda k: F.pow(F.lit(10.0), k).cast("bigint")
    l, r = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n - half)
    out = permute_number(F.when(half > 0, l.cast("bigint")).otherwise(F.lit(0)), r.cast("bigint"), size(half), size(n - half), key, tweak)
    padded = lambda v, k: F.when(k > 0, F.lpad(v.cast("string"), k, "0")).otherwise(F.lit(""))
    return let(out, lambda p: F.concat(padded(p["l"], half), padded(p["r"], n - half)))


def permute_name(name: Column, key: str, tweak: str) -> Column:
    """Another string with letters, capitals and digits (ASCII) in the same places.

    Two halves are shifted in turn by hashes of the other half, each character within its class.
    """
    alphabets = [F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("0123456789")]

    def shift(text: Column, by) -> Column:
        """Shift character ``j`` (from 0) by ``by(j)``."""

        def one(c: Column, j: Column) -> Column:
            moved = F.lit(None).cast("string")
            for a in alphabets:
                at, n = F.instr(a, c), F.length(a)
                moved = F.coalesce(moved, F.when(at > 0, F.substring(a, F.pmod(at - 1 + by(j), n) + 1, F.lit(1))))
            return F.coalesce(moved, c)

        return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")

    def rounds(pair: Column, sign: int) -> Column:
        def step(acc: Column, i: Column) -> Column:
            even = i % 2 == 0
            other = F.when(even, acc["r"]).otherwise(acc["l"])
            by = lambda j: sign * F.pmod(_hash_number(key, tweak, i * 1000 + j, other), F.lit(26 * 10))
            moved = shift(F.when(even, acc["l"]).otherwise(acc["r"]), by)
            return F.struct(F.when(even, moved).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(moved).alias("r"))

        order = list(range(ROUNDS)) if sign > 0 else list(range(ROUNDS))[::-1]
        return F.aggregate(F.array(*[F.lit(i) for i in order]), pair, step)

    half = F.floor(F.length(name) / 2).cast("int")
    pair = F.struct(F.substring(name, F.lit(1), half).alias("l"), F.substring(name, half + 1, F.length(name)).alias("r"))
    turn = lambda p: F.struct(shift(p["l"], lambda j: F.lit(1)).alias("l"), shift(p["r"], lambda j: F.lit(1)).alias("r"))
    return let(let(rounds(pair, 1), lambda p: rounds(turn(p), -1)), lambda p: F.concat(p["l"], p["r"]))


def only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def put_digits(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced in order; everything else stays."""
    chars = F.filter(F.split(m, ""), lambda c: c != "")
    rank = lambda i: F.length(only_digits(F.substring(m, F.lit(1), i + 1)))
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, rank(i), F.lit(1))).otherwise(c)), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a number whose last digit is its check digit."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(F.pmod(F.length(digits) - 1 - i, F.lit(2)) == 1, doubled).otherwise(d)

    chars = F.filter(F.split(digits, ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, value), F.lit(0), lambda a, x: a + x)


def _card(m: Column, key: str) -> Column:
    def swap(d: Column) -> Column:
        payload = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        check = lambda p: F.pmod(10 - F.pmod(luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
        return F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, let(payload, lambda p: put_digits(m, F.concat(p, check(p))))).otherwise(m)

    return let(only_digits(m), swap)


def _phone(m: Column, key: str) -> Column:
    """The country code stays."""
    code = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])|^\+\d", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))

    def swap(x: Column) -> Column:
        n = F.length(x["d"])
        return F.when((n >= 7) & (n <= 15), F.concat(x["c"], put_digits(x["r"], permute_digits(x["d"], key, "phone")))).otherwise(m)

    return let(F.struct(code.alias("c"), rest.alias("r"), only_digits(rest).alias("d")), swap)


def _ipv4(m: Column, key: str) -> Column:
    def swap(p: Column) -> Column:
        n = F.transform(p, lambda x: x.cast("bigint"))
        new = permute_number(n[0] * 256 + n[1], n[2] * 256 + n[3], 65_536, 65_536, key, "ipv4")
        part = lambda v: [F.floor(v / 256).cast("string"), F.pmod(v, F.lit(256)).cast("string")]
        valid = F.forall(p, lambda x: (x.cast("int") <= 255) & ((F.length(x) == 1) | ~x.startswith("0")))
        return F.when(valid, let(new, lambda q: F.concat_ws(".", *part(q["l"]), *part(q["r"])))).otherwise(m)

    return let(F.split(m, "[.]"), swap)


def _ssn(m: Column, key: str) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999."""
    area, group, serial = (F.split(m, "-")[i].cast("bigint") for i in range(3))
    valid = (area >= 1) & (area < 900) & (area != 666) & (group >= 1) & (serial >= 1)
    rank = F.when(area > 666, area - 2).otherwise(area - 1)

    def write(q: Column) -> Column:
        a = F.floor(q["l"] / 99)
        return F.concat_ws("-", F.lpad((F.when(a >= 665, a + 2).otherwise(a + 1)).cast("string"), 3, "0"), F.lpad((F.pmod(q["l"], F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((q["r"] + 1).cast("string"), 4, "0"))

    return F.when(valid, let(permute_number(rank * 99 + group - 1, serial - 1, 898 * 99, 9_999, key, "ssn"), write)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    """Year first; with points day first; with strokes month first.  Separators may not be mixed."""
    digits = only_digits(m)
    sep = F.regexp_extract(m, "[^0-9]", 0)
    mixed = F.size(F.array_distinct(F.regexp_extract_all(m, F.lit("[^0-9]"), F.lit(0)))) > 1
    year_first = m.rlike(r"^\d{4}")
    iso = F.when(year_first, digits).when(sep == ".", F.concat(digits.substr(5, 4), digits.substr(3, 2), digits.substr(1, 2))).otherwise(F.concat(digits.substr(5, 4), digits.substr(1, 4)))
    day = F.datediff(F.try_to_timestamp(iso, F.lit("yyyyMMdd")).cast("date"), F.lit(FIRST_DAY).cast("date"))

    def write(q: Column) -> Column:
        d = F.date_add(F.lit(FIRST_DAY).cast("date"), (q["l"] * 4_297 + q["r"]).cast("int"))
        return F.when(year_first, F.concat_ws("", F.date_format(d, "yyyy"), sep, F.date_format(d, "MM"), sep, F.date_format(d, "dd"))).when(
            sep == ".", F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy"))

    def swap(x: Column) -> Column:
        fits = x.isNotNull() & (x >= 0) & (x < DAYS) & ~mixed
        return F.when(fits, let(permute_number(F.floor(x / 4_297), F.pmod(x, F.lit(4_297)), 17, 4_297, key, "date"), write)).otherwise(m)

    return let(day, swap)


def _email(m: Column, key: str) -> Column:
    parts = F.split(m, "@")
    return let(parts, lambda p: F.concat(permute_name(p[0], key, "email"), F.lit("@"), p[1]))


def _kind(m: Column) -> Column:
    found = F.when(m.contains("@"), F.lit("email"))
    for kind, pattern in (("ipv4", IPV4), ("phone", PHONE), ("ssn", SSN), ("date", DATE)):
        found = found.when(m.rlike(f"^(?:{pattern})$"), F.lit(kind))
    return found.otherwise(F.lit("card"))


def pseudonym(m: Column, key: str) -> Column:
    """Pseudonym of one match; the match itself if it fails the check of its format."""

    def swap(x: Column) -> Column:
        v, k = x["m"], x["k"]
        makers = {"email": _email, "ipv4": _ipv4, "phone": _phone, "ssn": _ssn, "date": _date}
        out = F.when(F.lit(False), v)
        for name, make in makers.items():
            out = out.when(k == name, make(v, key))
        return out.otherwise(_card(v, key))

    return let(F.struct(m.alias("m"), _kind(m).alias("k")), swap)


SPANS = "array<struct<kind:string,s:int,e:int,pseudonym:string>>"
MATCHES = "array<struct<s:int,e:int,m:string>>"


def _weave(t: Column, spans: Column, put) -> Column:
    """``t`` with ``put(span)`` in the places of the spans."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, x: F.struct(x["e"].alias("at"), F.concat(acc["out"], F.array(F.substring(t, acc["at"] + 1, x["s"] - acc["at"]), put(x))).alias("out"))
    woven = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["at"] + 1, F.length(t))))
    return F.when(F.size(spans) > 0, woven).otherwise(t)


def _valid(hits: Column, kind, make) -> Column:
    """Spans of the matches that their check accepts."""
    told = F.transform(hits, lambda x: let(make(x["m"]), lambda p: F.struct(kind(x["m"]).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), p.alias("p"))))
    return F.transform(F.filter(told, lambda x: x["m"] != x["p"]), lambda x: F.struct(x["kind"], x["s"], x["e"], x["p"].alias("pseudonym"))).cast(SPANS)


def _is_card(m: Column) -> Column:
    return let(only_digits(m), lambda d: F.length(d).between(13, 19) & (F.pmod(luhn_sum(d), F.lit(10)) == 0))


def _grouped_cards(row: Column) -> Column:
    """Cards in one number or in usual groups with one separator throughout, anywhere in a row of numbers, as spans of the text."""

    def of_numbers(numbers: Column) -> Column:
        def end(i: Column, sizes: tuple[int, ...]) -> Column:
            """End of the card of such groups from number ``i``, or null."""
            at = [F.get(numbers, i + j) for j in range(len(sizes) or 1)]
            fits = F.lit(True)
            for x, size in zip(at, sizes):
                fits = fits & F.coalesce(x["e"] - x["s"] == size, F.lit(False))
            for x, y in zip(at, at[1:]):  # numbers of a row stand one separator apart
                fits = fits & (row["m"].substr(y["s"], F.lit(1)) == row["m"].substr(at[1]["s"], F.lit(1)))
            return F.when(fits & _is_card(row["m"].substr(at[0]["s"] + 1, at[-1]["e"] - at[0]["s"])), at[-1]["e"])

        def step(acc: Column, x: Column) -> Column:
            def put(e: Column) -> Column:
                hit = F.struct((row["s"] + x["s"]).alias("s"), (row["s"] + e).alias("e"), row["m"].substr(x["s"] + 1, e - x["s"]).alias("m"))
                return F.when(e > 0, F.struct(e.alias("to"), F.concat(acc["out"], F.array(hit)).alias("out"))).otherwise(acc)

            found = F.when(x["s"] >= acc["to"], F.coalesce(*[end(x["i"], sizes) for sizes in ((), *GROUPS)]))
            return let(F.coalesce(found, F.lit(0)), put)

        start = F.struct(F.lit(0).alias("to"), F.array().cast(MATCHES).alias("out"))
        placed = F.transform(numbers, lambda x, i: F.struct(x["s"].alias("s"), i.alias("i")))
        return F.aggregate(placed, start, step, lambda acc: acc["out"])

    return let(match_spans(row["m"], NUMBER), of_numbers)


def _with_spans(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """``docs`` with a further column, and its name: the replaced values of the text as ``SPANS``, in order."""
    if not key:
        raise ValueError("pseudonyms need a secret key")
    left, own, all_ = (_unused(docs, name) for name in ("left", "own", "pii"))
    card, phone = (lambda m: F.lit("card")), (lambda m: F.lit("phone"))
    passes = (
        lambda t: _valid(match_spans(t, MARKED, GATE), _kind, lambda m: pseudonym(m, key)),
        lambda t: _valid(F.flatten(F.transform(match_spans(t, ROW, ROW_GATE), _grouped_cards)), card, lambda m: _card(m, key)),
        lambda t: _valid(match_spans(t, PHONE, "[+(]"), phone, lambda m: _phone(m, key)),
        lambda t: _valid(match_spans(t, CARD, ROW_GATE), card, lambda m: _card(m, key)),
    )
    # one projection a pass: as one expression they nest deeper than the analyzer goes
    rows = docs.withColumns({left: F.coalesce(F.col(f"`{text}`"), F.lit("")), all_: F.array().cast(SPANS)})
    for find in passes:
        # found values are covered by as many characters that no format holds
        covered = _weave(F.col(left), F.col(own), lambda v: F.repeat(F.lit("|"), v["e"] - v["s"]))
        rows = rows.withColumn(own, find(F.col(left))).withColumns({left: covered, all_: F.concat(all_, own)})
    by_place = F.sort_array(F.transform(all_, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), x["pseudonym"].alias("pseudonym"))))
    return rows.withColumn(all_, F.transform(by_place, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["pseudonym"].alias("pseudonym")))), all_


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


#: Setting that holds the secret key; runs with the same key give equal values equal pseudonyms.
KEY_SETTING = "spark.linkloom.pii.key"


def run_key(spark: SparkSession) -> str:
    """The key of the session, or, where none is set, a new one that nobody keeps: it links the values of this run only."""
    return spark.conf.get(KEY_SETTING, None) or token_hex(32)


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the text's personal values replaced; columns and their order as they were."""
    rows, spans = _with_spans(docs, key, text)
    new = _weave(F.col(f"`{text}`"), F.col(spans), lambda v: v["pseudonym"])
    return rows.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def found_values(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Per document ``doc_id``, the new ``text`` and the replaced spans ``kind, s, e, pseudonym``."""
    rows, spans = _with_spans(docs, key, text)
    new = _weave(F.col(f"`{text}`"), F.col(spans), lambda v: v["pseudonym"])
    return rows.select("doc_id", new.alias("text"), F.col(spans).alias("spans"))
