"""Format-preserving pseudonyms for personal data.

Zones of text in which values may begin are found by one expression. At every beginning the ends
that a value may have are tried (IBANs at the length of their country, cards and phones at every
number of digits from long to short); the first valid one (check digits, ranges, calendar) is taken,
and the search goes on behind it. A value is replaced by a keyed permutation of their format: a Feistel network of ROUNDS rounds with SHA-256 of the key,
the format, the round and the other half. A permutation has no collisions, so equal values stay
equal and different ones stay different in all documents, and without the key nothing is undone.

kind    validated by                       permuted
email   the form                           letters and digits before the @, each in its class
iban    remainder 97                       account part, each in its class; new check digits
card    Luhn's check digit, 13-19 digits   all digits but the last; new check digit
ssn     area, group and serial ranges      index in the valid areas x groups x serials
phone   + and 8-15 digits, or 3-3-4        digits after the country code
ip      four numbers up to 255             the 32-bit address
date    calendar, years 1900-2099          the number of the day, in the same layout
secret  an assignment to a secret's name   letters and digits, each in its class

Separators, country codes, domains and layouts stay. What fails validation stays as it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8                                     # even, so that the halves end where they began
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)     # 73,049 days up to 2099-12-31 = 17 x 4,297
AREAS, GROUPS_SERIALS = 898, 99 * 9999         # 001-899 without 666; 01-99 and 0001-9999

#: The written forms. No form starts inside a longer run of its own characters.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9-]*+(?:\.(?=[A-Za-z0-9]))?)++",
    "secret": r"(?<![A-Za-z0-9])(?:[Tt]oken|[Pp]assw(?:or)?d|[Ss]ecret|[Aa][Pp][Ii][_-]?[Kk]ey|[Aa]ccess[_-]?[Kk]ey)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?[A-Za-z0-9+/_-]{8,}+"
              r"|(?<![A-Za-z0-9])AKIA[0-9A-Z]{8,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,12}){1,5}+(?![0-9])"
             r"|(?<![A-Za-z0-9.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-]?[0-9])",
    "date": r"(?:(?<![0-9./-])|(?<=[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}[-/.])|(?<=[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4}[-/.]))(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}(?!\1?[0-9])|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4}(?!\2?[0-9]))",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}+(?![0-9])",
}
#: Where a value may begin: forms with one end as they are, the least of the others.
BEGINS = "|".join(f"(?:{f})" for f in [FORMS["email"], FORMS["secret"], r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11}", r"(?<![A-Za-z0-9+])\+(?:[ .()-]{0,3}[0-9]){8}",
                  FORMS["phone"].split("|", 1)[1], FORMS["date"], FORMS["ssn"], FORMS["ip"], r"(?<![0-9])[0-9](?:[ -]?[0-9]){12}"])
#: What a zone goes on over: all that a value begun in it, or one behind that, may hold.
ON = r"(?:[A-Za-z0-9._%+@()/-]|[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?(?=[A-Za-z0-9+/_-])| (?=[(+]{0,2}[0-9A-Z]))*+"
#: Lengths of IBANs by country, and of phone numbers with the country code where there is one length.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
                23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
                28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
PHONE_DIGITS = {10: "45 47", 11: "1 7 31 33 34 41 48 61", 12: "30 44 91 351", 13: "86"}
#: Characters before a beginning that the forms look back at.
BACK = 11


def _renumbered(form: str, first: int) -> str:
    """Back references of the date form, counted in the whole expression."""
    return form.replace(r"\2", rf"\{first + 1}").replace(r"\1", rf"\{first}")


def _number(key: str, *parts: Column) -> Column:
    """60 bits of SHA-256 of the key and the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def permuted_number(value: Column, a: Column, b: Column, key: str, form: Column) -> Column:
    """Permutation of 0 .. a*b-1 (a and b at most 10^9): the halves value div b and value mod b
    are moved in turn by a keyed number of the other."""
    start = F.struct(F.floor(value / b).cast("long").alias("x"), (value % b).cast("long").alias("y"), a.cast("long").alias("m"), b.cast("long").alias("n"))

    def turn(s: Column, i: Column) -> Column:
        return F.struct(s["y"].alias("x"), F.pmod(s["x"] + _number(key, form, i, s["y"]), s["m"]).alias("y"), s["n"].alias("m"), s["m"].alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["x"] * s["n"] + s["y"])


def _moved(text: Column, other: Column, i: Column, key: str, form: Column) -> Column:
    """Every letter and digit of `text` moved within its class by bytes of a keyed digest."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), form, i.cast("string"), other), 256)

    def move(c: Column, at: Column) -> Column:
        by = F.conv(digest.substr(F.pmod(at, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(at / 32).cast("int")
        in_class = lambda first, size: F.char(F.lit(first) + F.pmod(F.ascii(c) - first + by, F.lit(size)))
        return (F.when(c.between("0", "9"), in_class(48, 10)).when(c.between("a", "z"), in_class(97, 26))
                .when(c.between("A", "Z"), in_class(65, 26)).otherwise(c))
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), move), "")


def permuted_text(value: Column, key: str, form: str) -> Column:
    """Permutation of strings of one shape: digits, small and capital letters stay what they are
    and other characters stay. The halves are moved in turn by a digest of the other."""
    shape = F.concat(F.lit(form), F.char_length(value).cast("string"))
    half = F.floor(F.char_length(value) / 2).cast("int")
    start = F.struct(F.left(value, half).alias("x"), value.substr(half + 1, F.char_length(value)).alias("y"))
    turn = lambda s, i: F.struct(s["y"].alias("x"), _moved(s["x"], s["y"], i, key, shape).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["x"], s["y"]))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def permuted_digits(digits: Column, key: str, form: str) -> Column:
    """Permutation of digit strings of one length, up to 18 digits."""
    n = F.char_length(digits)
    half = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    moved = permuted_number(digits.cast("long"), power(half), power(n - half), key, F.concat(F.lit(form), n.cast("string")))
    return F.lpad(moved.cast("string"), n, "0")


def refilled(mask: Column, filling: Column) -> Column:
    """`mask` with its letters and digits replaced, in order, by the characters of `filling`."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        taken = c.rlike("[A-Za-z0-9]")
        return F.struct((s["at"] + taken.cast("int")).alias("at"), F.concat(s["out"], F.when(taken, filling.substr(s["at"], F.lit(1))).otherwise(c)).alias("out"))
    return F.aggregate(F.split(mask, ""), start, step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a digit string, the last digit counted once and the one before doubled."""
    def part(d: Column, i: Column) -> Column:
        twice = d.cast("int") * (1 + i % 2)
        return F.when(twice > 9, twice - 9).otherwise(twice)
    return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), part), F.lit(0), lambda a, x: a + x)


def remainder_97(text: Column) -> Column:
    """Remainder of the number that letters (A = 10) and digits spell."""
    def step(s: Column, c: Column) -> Column:
        letter = c.between("A", "Z")
        return F.when(c == "", s).when(letter, (s * 100 + F.ascii(c) - 55) % 97).otherwise((s * 10 + F.ascii(c) - 48) % 97).cast("int")
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _email(m: Column, key: str) -> tuple[Column, Column]:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return domain.contains("."), F.concat(permuted_text(local, key, "email"), F.lit("@"), domain)


def _secret(m: Column, key: str) -> tuple[Column, Column]:
    value = F.regexp_extract(m, r"([A-Za-z0-9+/_-]{8,})$", 1)
    aws = m.startswith("AKIA")
    value = F.when(aws, F.substring(m, 5, 10 ** 6)).otherwise(value)
    return F.lit(True), F.concat(F.left(m, F.char_length(m) - F.char_length(value)), permuted_text(value, key, "secret"))


def _iban(m: Column, key: str) -> tuple[Column, Column]:
    bare = F.replace(m, F.lit(" "), F.lit(""))
    account, country = F.substring(bare, 5, 100), F.left(bare, F.lit(2))
    moved = permuted_text(account, key, "iban")
    check = F.lpad((98 - remainder_97(F.concat(moved, country, F.lit("00")))).cast("string"), 2, "0")
    return remainder_97(F.concat(account, F.left(bare, F.lit(4)))) == 1, refilled(m, F.concat(country, check, moved))


def _card(m: Column, key: str) -> tuple[Column, Column]:
    digits = digits_of(m)
    moved = permuted_digits(F.left(digits, F.char_length(digits) - 1), key, "card")
    check = F.pmod(10 - luhn_sum(F.concat(moved, F.lit("0"))) % 10, F.lit(10)).cast("string")
    return luhn_sum(digits) % 10 == 0, refilled(m, F.concat(moved, check))


def _ssn(m: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.substring(m, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = (area - F.when(area > 666, 2).otherwise(1)) * GROUPS_SERIALS + (group - 1) * 9999 + serial - 1

    def shown(x: Column) -> Column:
        a = F.floor(x / GROUPS_SERIALS) + 1
        rest = x % GROUPS_SERIALS
        return F.concat_ws("-", *[F.lpad(v.cast("string"), n, "0") for v, n in (
            (a + (a >= 666).cast("int"), 3), (F.floor(rest / 9999) + 1, 2), (rest % 9999 + 1, 4))])
    return valid, _given(permuted_number(index, F.lit(AREAS), F.lit(GROUPS_SERIALS), key, F.lit("ssn")), shown)


def _phone(m: Column, key: str) -> tuple[Column, Column]:
    kept = F.when(m.startswith("+"), F.regexp_extract(m, r"^\+[0-9]{1,3}", 0)).otherwise(F.lit(""))
    rest = m.substr(F.char_length(kept) + 1, F.char_length(m))
    n = F.char_length(digits_of(m))
    return n.between(8, 15) & (F.char_length(digits_of(rest)) > 3), F.concat(kept, refilled(rest, permuted_digits(digits_of(rest), key, "phone")))


def _ip(m: Column, key: str) -> tuple[Column, Column]:
    part = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    index = F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    shown = lambda x: F.concat_ws(".", *[F.shiftright(x, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0)])
    return F.forall(part, lambda x: x <= 255), _given(permuted_number(index, F.lit(65536), F.lit(65536), key, F.lit("ip")), shown)


def _date(m: Column, key: str) -> tuple[Column, Column]:
    """Year first, or day first where that is a day, or else month first: three layouts, each
    permuted within itself."""
    a, b, c = (F.regexp_extract(m, r"^([0-9]+).([0-9]+).([0-9]+)$", k) for k in (1, 2, 3))
    mark = F.regexp_extract(m, r"([-/.])", 1)
    day = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, mo, d), "yyyy-MM-dd")
    first, day_first = F.char_length(a) == 4, day(c, b, a)
    value = F.when(first, day(a, b, c)).otherwise(F.coalesce(day_first, day(c, a, b)))
    layout = F.when(first, "year").when(day_first.isNotNull(), "day").otherwise("month")
    index = F.date_diff(value, F.lit(FIRST_DAY).cast("date"))

    def shown(x: Column) -> Column:
        d = F.date_add(F.lit(FIRST_DAY).cast("date"), x.cast("int"))
        y, mo, dd = (F.date_format(d, f) for f in ("yyyy", "MM", "dd"))
        return F.when(first, F.concat_ws("", y, mark, mo, mark, dd)).when(layout == "day", F.concat_ws("", dd, mark, mo, mark, y)).otherwise(
            F.concat_ws("", mo, mark, dd, mark, y))
    valid = value.isNotNull() & index.between(0, DAYS[0] * DAYS[1] - 1)
    return F.coalesce(valid, F.lit(False)), _given(permuted_number(index, F.lit(DAYS[0]), F.lit(DAYS[1]), key, F.concat(F.lit("date"), layout)), shown)


def _given(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once."""
    return F.transform(F.array(value), use)[0]


KINDS = {"email": _email, "secret": _secret, "iban": _iban, "phone": _phone, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card}


def _judged(m: Column, key: str) -> Column:
    """struct(kind, shown, size) of one candidate: the first kind in order whose form it has and
    whose validation it passes; kind null if there is none."""
    kind, shown = None, None
    for name, rule in KINDS.items():
        valid, moved = rule(m, key)
        is_it = m.rlike(f"^(?:{FORMS[name]})$") & valid
        kind = F.when(is_it, F.lit(name)) if kind is None else kind.when(is_it, F.lit(name))
        shown = F.when(is_it, moved) if shown is None else shown.when(is_it, moved)
    return F.struct(kind.alias("kind"), shown.otherwise(m).alias("shown"), F.char_length(m).alias("size"))


def _ends(rest: Column) -> Column:
    """The candidates that begin BACK characters into `rest`, in the order in which they are tried."""
    at = lambda form: F.regexp_extract(rest, rf"(?s)^.{{{BACK}}}({_renumbered(form, 2)})", 1)
    begins = lambda form: rest.rlike(rf"(?s)^.{{{BACK}}}{form}")
    none = F.array().cast("array<string>")
    iban = "|".join(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
    ibans = [f"(?:{iban})(?![A-Za-z0-9])", *[rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{{n}}}(?![A-Za-z0-9])" for n in range(30, 10, -1)]]
    national = "|".join(rf"(?=\+(?:{codes.replace(' ', '|')}))\+(?:[ .()-]{{0,3}}[0-9]){{{n}}}" for n, codes in PHONE_DIGITS.items())
    # no end in the middle of a date or another number with marks unless there is no better one
    phones = [f"(?:{national})(?![0-9])", *[rf"\+(?:[ .()-]{{0,3}}[0-9]){{{n}}}(?!{mark}[0-9])" for mark in ("[-./]?", "") for n in range(15, 7, -1)]]
    # beside other numbers, only the last group of a card has fewer than four digits
    cards = F.concat(*[F.concat(F.array(at(rf"(?<![0-9][ -])[0-9](?:[ -]?[0-9]){{12,18}}+(?![ -]?[0-9]){mark}")), F.filter(F.array(*[
        at(rf"[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9]){mark}") for n in range(19, 12, -1)]), lambda c: c.rlike("^(?:[0-9]{4,}[ -])*[0-9]+$"))) for mark in ("(?![-./][0-9])", "")])
    found = F.concat(F.array(at(f"(?:{FORMS['email']})|(?:{FORMS['secret']})")),
                     F.when(begins("[A-Z]{2}[0-9]{2}"), F.array(*[at(f) for f in ibans])).otherwise(none),
                     F.when(begins(r"\+"), F.array(*[at(f) for f in phones])).otherwise(none),
                     F.array(at("|".join(f"(?:{f})" for f in (FORMS["phone"].split("|", 1)[1], FORMS["date"], FORMS["ssn"], FORMS["ip"])))),
                     F.when(begins("[0-9](?:[ -]?[0-9]){12}"), cards).otherwise(none))
    return F.array_distinct(F.filter(found, lambda c: c != ""))


def _zone(zone: Column, key: str) -> Column:
    """struct(text, kinds) of a zone: from left to right, at every beginning outside the values
    taken before, the first candidate that is valid."""
    nothing = F.struct(F.lit(None).cast("string").alias("kind"), F.lit("").alias("shown"), F.lit(0).alias("size"))

    def best(rest: Column) -> Column:
        return F.aggregate(_ends(rest), nothing, lambda s, m: F.when(s["kind"].isNotNull(), s).otherwise(_judged(m, key)))

    def done(pieces: Column) -> Column:
        def step(s: Column, piece: Column) -> Column:
            size, behind = F.char_length(piece), F.char_length(s["rest"]) - BACK
            # `over`: characters of the value taken last that are still to come
            def taken(b: Column) -> Column:
                valid = b["kind"].isNotNull()
                over = F.when(valid, b["size"]).otherwise(s["over"])
                left = F.substring(s["rest"], BACK + 1, 2 ** 31 - 1 - BACK)
                shown = F.concat(F.when(valid, b["shown"]).otherwise(F.lit("")), piece.substr(over + 1, size))
                return F.struct(left.substr(size + 1, behind).alias("__left"), F.greatest(over - size, F.lit(0)).alias("over"), shown.alias("shown"), b["kind"].alias("kind"),
                                F.concat(F.left(s["rest"], F.lit(BACK)), piece).alias("__before"))
            b = F.when(s["over"] > 0, nothing).otherwise(best(s["rest"]))
            return F.transform(F.array(b), lambda x: F.transform(F.array(taken(x)), lambda t: F.struct(
                F.concat(F.right(t["__before"], F.lit(BACK)), t["__left"]).alias("rest"), t["over"].alias("over"), F.concat(s["out"], t["shown"]).alias("out"),
                F.when(t["kind"].isNull(), s["kinds"]).otherwise(F.concat(s["kinds"], F.array(t["kind"]))).alias("kinds")))[0])[0]
        start = F.struct(F.concat(F.lit("\n" * BACK), zone).alias("rest"), F.lit(0).alias("over"), F.lit("").alias("out"), F.array().cast("array<string>").alias("kinds"))
        return F.aggregate(pieces, start, step, lambda s: F.struct(s["out"].alias("text"), s["kinds"].alias("kinds")))
    return done(F.split(zone, f"(?={_renumbered(BEGINS, 1)})", -1))


def pseudonymised(text: Column, key: str) -> Column:
    """struct(text, kinds) of a text column: every valid value replaced, and their kinds in
    order. Null gives null and no kinds."""
    pattern = f"(?:{_renumbered(BEGINS, 1)}){ON}"

    def rebuilt(found: Column) -> Column:
        def joined(zones: Column) -> Column:
            between = F.split(text, pattern, -1)
            whole = F.concat(F.array_join(F.transform(zones, lambda z, i: F.concat(F.get(between, i), z["text"])), ""), F.element_at(between, -1))
            return F.struct(whole.alias("text"), F.flatten(F.transform(zones, lambda z: z["kinds"])).alias("kinds"))
        return F.transform(F.array(F.transform(found, lambda z: _zone(z, key))), joined)[0]

    def whole(found: Column) -> Column:
        nothing = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
        return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, rebuilt(found)).otherwise(nothing)
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), whole)[0]


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, n_private and kinds (one entry for each
    replaced value, in order).

    Rows without personal data keep their text to the byte; null stays null, empty stays empty.
    Repeated rows get the same result; an empty table gives no rows; other columns are not looked
    at. Texts are searched whole."""
    done = docs.select(F.col(id_col).alias("doc_id"), pseudonymised(F.col(text_col), key).alias("__done"))
    return done.select("doc_id", F.col("__done.text").alias("text"), F.size("__done.kinds").alias("n_private"), F.col("__done.kinds").alias("kinds"))
