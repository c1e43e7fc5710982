"""Personal data and secrets are replaced by surrogates of the same type and format.

Every entity has a canonical form (no separators, lower case); its surrogate is drawn from a
keyed hash of that form, so the same entity gets the same surrogate in all documents and in all
its spellings. Surrogates are checked against each other and against the real entities; those
that collide are drawn again, so different entities stay different. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from answerflow.llm.common import store

_PART = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}++(?:\p{Lu}\p{Ll}++)?"
_NAME = rf"{_PART}(?:-{_PART})*+"
# Titles by the gender they tell; the last ones tell none.
TITLES_F = ("Mrs", "Ms", "Miss", "Dame", "Frau", "Mme", "Madame", "Sra", "Señora", "Госпожа", "Κυρία")
TITLES_M = ("Mr", "Sir", "Herr", "Monsieur", "Sr", "Señor", "Господин", "Κύριος")
TITLES_N = ("Dr", "Prof", "Professor", "Doctor")
TITLES = TITLES_F + TITLES_M + TITLES_N
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# With the area code in brackets or plain, with or without a country code.
_LOCAL = (
    r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?!\w)"
    r"|(?<![\w+])(?<![0-9][.-])(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?!\w|[.-][0-9])"
)
#: Country codes of one, two and three digits.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_SSN = r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-]|\.[0-9])"
# The countries of account numbers (IBAN) by how long theirs are.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC",
}
_IBAN = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_GROUP = "[0-9A-Fa-f]{1,4}"
# Eight groups, or fewer around one "::".
_IPV6 = (
    rf"(?<![\w:.])(?=[A-Fa-f:]*+[0-9])(?:(?:{_GROUP}:){{7}}{_GROUP}"
    rf"|(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:{_GROUP}(?::{_GROUP}){{0,6}})?)(?![\w:]|\.[0-9])"
)
# How the tokens of well-known services, and signed ones of three parts, begin.
TOKEN_START = r"^(?:gh[pousr]_|github_pat_|glpat-|npm_|hf_|sk_(?:live|test)_|sk-|xox[abprs]-|AIza|eyJ)"
_TOKEN = (
    r"(?<![\w-])(?:(?:gh[pousr]|npm|hf|sk_(?:live|test))_[A-Za-z0-9]{16,}+|github_pat_\w{20,}+|AIza[\w-]{30,}+"
    r"|(?:glpat|sk|xox[abprs])-(?=[A-Za-z_-]*+[0-9])[\w-]{16,}+|eyJ[\w-]++\.eyJ[\w-]++\.[\w-]++)"
)
_KEY_START, _KEY_END = (rf"-----{w} [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----" for w in ("BEGIN", "END"))
_KEY_BLOCK = rf"{_KEY_START}[^-]*+(?:-(?!----END)[^-]*+)*+{_KEY_END}"
# After a colon, letters with more words or the end of a sentence behind them are prose.
_PROSE = r"(?<=:[ \t]{0,8})\p{L}++(?:[.!?]|[,;:)]*+[ \t]++\S)"
_KEYWORD = r"(?i:(?<!\w)(?:password|passwd|secret|token|api_?key|secret_?key)[\"']?\s*[=:]\s*)"
#: What each kind looks like; the first that fits from a place on is taken.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.(?=[A-Za-z]{2,}+(?![A-Za-z0-9])|[A-Za-z0-9-]++\.))++[A-Za-z]{2,}+(?![A-Za-z0-9])",
    "ssn": _SSN,
    "iban": rf"(?<!\w)(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?!\w)",
    "ipv6": _IPV6,
    "token": _TOKEN,
    "key block": _KEY_BLOCK,
    "phone": rf"{_LOCAL}|(?<![\w+])\+[0-9](?:[ .()-]{{0,2}}[0-9]){{6,14}}(?!\w)",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.[0-9])",
    # A run of numbers that may have card numbers (see `pieces`); the start of an address is none.
    "card": r"(?<!\w)[0-9][0-9 -]{11,}[0-9](?!\w|\.[0-9]|[A-Za-z0-9._%+-]{0,64}+@)",
    "key": r"(?<!\w)AKIA[A-Z0-9]{16}(?!\w)",
    # In quotes up to the closing one, else up to a blank; punctuation at the end is left out.
    "secret": rf"{_KEYWORD}(?:\"[^\"\r\n]+(?=\")|'[^'\r\n]+(?=')|(?!{_PROSE})\S*[^\s.,;:!?()\[\]{{}}<>\"'])|(?<=\")[0-9A-Fa-f]{{32,}}(?=\")",
    "name": rf"(?<!\w)(?:{'|'.join(TITLES)})\.? {_NAME}(?: {_NAME})*+",
}
LEAD = rf"^{_KEYWORD}[\"']?"
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity has one of these; most texts have none, and a look at single characters is fast.
HINT = (
    r"[0-9@]|[dntyDNTY][\"']?\s*[=:]|AKIA|AIza|eyJ|(?:gh[pousr]|pat|npm|hf|live|test)_|PRIVATE KEY|\"[0-9A-Fa-f]{32}|["
    + "".join(sorted({t[0] for t in TITLES})) + rf"](?:{'|'.join(t[1:] for t in TITLES)})\.? \p{{Lu}}"
)
# Attempts before the shape of a surrogate is widened.
NARROW = 6
#: Set around what is found in a run of numbers, which has none of these.
MARK = "\x01"
LETTERS, DIGITS, HEX, BASE32 = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# Syllables of invented names by script, and the endings of given names by gender.
SYLLABLES = {
    "latin": [c + v for c in "bdfglmnrstvz" for v in "aeiou"],
    "cyrillic": [c + v for c in "бвгдзклмнрст" for v in "аеиоу"],
    "greek": [c + v for c in "βγδθκλμνρστφ" for v in "αειου"],
}
ENDINGS = {
    ("latin", "f"): "na", ("latin", "m"): "ron", ("cyrillic", "f"): "на", ("cyrillic", "m"): "рон",
    ("greek", "f"): "να", ("greek", "m"): "ρος", ("latin", "n"): "lin", ("cyrillic", "n"): "лин", ("greek", "n"): "λιν",
}


def kind_of(value: Column) -> Column:
    """The first kind whose pattern the whole value has."""
    return F.coalesce(
        *[F.when(value.rlike(rf"^(?:{_alone(k)})$"), F.lit(k)) for k in PATTERNS if k != "secret"],
        F.lit("secret"),
    )


def _alone(kind: str) -> str:
    # The surroundings were checked where it was found.
    return PATTERNS[kind]


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits with every second one from the right doubled; the check digit included."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def remainder_97(text: Column) -> Column:
    """The remainder by 97 of a number in digits and letters (A is 10, Z is 35)."""
    def add(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(add(rest, c)))


def right_iban(value: Column) -> Column:
    bare = F.regexp_replace(value, " ", "")
    return remainder_97(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))) == 1


def groups_of(address: Column) -> Column:
    """The eight groups of an IPv6 address, lower case, without zeros before them."""
    def part(at: int) -> Column:
        text = F.element_at(F.split(F.lower(address), "::"), at)
        return F.filter(F.split(text, ":"), lambda g: g != "")

    none = F.array().cast("array<string>")
    left, right = part(1), F.when(F.instr(address, "::") > 0, part(-1)).otherwise(none)
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0)))
    return F.transform(F.concat(left, zeros, right), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, also inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _in_run(blocks: Column) -> Column:
    """Numbers, each with what follows it up to the next, as an array of (kind, piece): the card
    numbers (13 to 19 digits in any groups, one blank or hyphen between them, right check digit;
    the first and longest), and phone and social security numbers in what is left."""
    n = F.size(blocks)

    def end(i: Column) -> Column:
        def is_card(j: Column) -> Column:
            run = F.array_join(F.slice(blocks, i, j - i + 1), "")
            right = _with(F.regexp_replace(run, "[^0-9]", ""), lambda d: luhn_sum(d) % 10 == 0)
            return F.when(run.rlike("^(?:[0-9][ -]?){12,18}[0-9][ -]*$"), right).otherwise(False)

        return F.array_max(F.filter(F.sequence(i, F.least(i + 18, n)), is_card))

    def picked(ends: Column) -> Column:
        none = F.array().cast("array<int>")

        def step(state: Column, i: Column) -> Column:
            last = F.get(ends, i - 1)
            take = (i >= state["next"]) & last.isNotNull()
            return F.struct(
                F.when(take, last + 1).otherwise(state["next"]).alias("next"),
                F.when(take, F.concat(state["first"], F.array(i))).otherwise(state["first"]).alias("first"),
                F.when(take, F.concat(state["last"], F.array(last))).otherwise(state["last"]).alias("last"),
            )

        start = F.struct(F.lit(1).alias("next"), none.alias("first"), none.alias("last"))
        return F.aggregate(F.sequence(F.lit(1), n), start, step)

    def marked(cards: Column) -> Column:
        def one(block: Column, i: Column) -> Column:
            opened = F.when(F.array_contains(cards["first"], i + 1), F.concat(F.lit(MARK), block)).otherwise(block)
            return F.when(F.array_contains(cards["last"], i + 1), F.regexp_replace(opened, "([0-9])([ -]*)$", f"$1{MARK}$2")).otherwise(opened)

        return F.array_join(F.transform(blocks, one), "")

    def kinds(text: Column, name: Callable[[Column], Column]) -> Column:
        return F.transform(
            F.split(text, MARK), lambda p, i: F.struct(F.when(i % 2 == 1, name(p)).alias("kind"), p.alias("piece"))
        )

    def short(piece: Column) -> Column:
        return F.when(piece.rlike(f"^{_SSN}$"), F.lit("ssn")).otherwise(F.lit("phone"))

    split = kinds(_with(_with(F.transform(F.sequence(F.lit(1), n), end), picked), marked), lambda _: F.lit("card"))
    return F.flatten(
        F.transform(split, lambda p: F.when(p["kind"].isNotNull(), F.array(p)).otherwise(kinds(F.regexp_replace(p["piece"], f"({_SSN}|{_LOCAL})", f"{MARK}$1{MARK}"), short)))
    )


def pieces(kind: Column, value: Column) -> Column:
    """The entities in a value and what is between them, in order, as an array of (kind, piece);
    the kind of what is no entity is null."""
    run = _with(F.regexp_extract_all(value, F.lit("[0-9]+[ -]*"), 0), _in_run)
    known = F.when((kind != "iban") | right_iban(value), kind)
    return F.when(kind == "card", run).otherwise(F.array(F.struct(known.alias("kind"), value.alias("piece"))))


def script_of(token: Column) -> Column:
    return F.when(token.rlike(r"\p{IsCyrillic}"), "cyrillic").when(token.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def hidden_part(value: Column) -> Column:
    """A secret without keyword and quote; long hexadecimal ones are the same in either case."""
    bare = F.regexp_replace(value, LEAD, "")
    return F.when(bare.rlike("^[0-9A-Fa-f]{32,}$"), F.lower(bare)).otherwise(bare)


def parts_of(kind: Column, value: Column) -> Column:
    """What a value consists of, as an array of (kind, form): one part, or the tokens of a name."""
    def one(name: str, form: Column) -> Column:
        return F.array(F.struct(F.lit(name).alias("kind"), form.alias("form")))

    digits = F.regexp_replace(value, "[^0-9]", "")
    words = F.split(F.regexp_replace(value, r"^\S+ ", ""), " ")
    titled = F.regexp_replace(F.substring_index(value, " ", 1), r"\.$", "")
    given = F.when(titled.isin(*TITLES_F), F.lit("given-f")).when(titled.isin(*TITLES_N), F.lit("given-n")).otherwise(F.lit("given-m"))
    names = F.transform(
        words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, F.lit("surname")).otherwise(given).alias("kind"), F.lower(w).alias("form"))
    )
    return (
        F.when(kind == "email", one("email", F.lower(value)))
        .when(kind == "phone", one("phone", F.concat(F.regexp_extract(value, r"^\+", 0), digits)))
        .when(kind == "ip", one("ip", value))
        .when(kind == "card", one("card", digits))
        .when(kind == "key", one("key", value))
        .when(kind == "ssn", one("ssn", digits))
        .when(kind == "iban", one("iban", F.regexp_replace(value, " ", "")))
        .when(kind == "ipv6", one("ipv6", F.array_join(groups_of(value), ":")))
        .when(kind == "token", one("token", value))
        .when(kind == "key block", one("key block", F.regexp_replace(value, f"^{_KEY_START}|{_KEY_END}$", "")))
        .when(kind == "secret", one("secret", hidden_part(value)))
        .when(kind == "name", names)
    )


def drawn(secret: str, kind: Column, form: Column, attempt: Column) -> Column:
    """64 bytes, in hexadecimal, that depend on the key, the entity and the attempt."""
    return F.concat(
        *[F.sha2(F.concat_ws("|", F.lit(secret), kind, form, attempt.cast("string"), F.lit(str(i))), 256) for i in range(2)]
    )


def byte(drawing: str, at: Column | int) -> Column:
    """Byte `at` of a column with drawn bytes; beyond the last they begin anew, one higher."""
    at = F.lit(at) if isinstance(at, int) else at
    value = F.conv(F.substr(F.col(drawing), (at % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return value + F.floor(at / 64).cast("int")


def _from(alphabet: str, number: Column) -> Column:
    return F.substr(F.lit(alphabet), number % len(alphabet) + 1, F.lit(1))


def _shaped(form: Column, drawing: str) -> Column:
    """Letters for letters, digits for digits, anything else as it is; letters for all if there
    are neither."""
    bare = ~form.rlike(r"[\p{L}\p{N}]")
    def swap(c: Column, i: Column) -> Column:
        n = byte(drawing, i)
        return F.when(c.rlike(r"\p{Lu}"), F.upper(_from(LETTERS, n))).when(c.rlike(r"\p{L}"), _from(LETTERS, n)).when(
            c.rlike(r"\p{N}"), _from(DIGITS, n)
        ).when(bare, _from(LETTERS, n)).otherwise(c)

    return F.when(F.length(form) == 0, form).otherwise(F.array_join(F.transform(F.split(form, ""), swap), ""))


def surrogate_form(kind: Column, form: Column) -> Column:
    """The surrogate in canonical form, of the same kind and shape as `form`; drawn from the
    columns `drawn` and, for the domain of an address, `drawn_domain`. From the column `attempt`
    NARROW on it is one character (or syllable) longer with each attempt, and a private IPv4
    address comes from the largest private range, later from all, so that a shape with fewer
    values than forms has free ones too."""
    at = lambda i: byte("drawn", i)
    more = F.greatest(F.col("attempt") - (NARROW - 1), F.lit(0))

    def longer(draw: Callable[[Column], Column]) -> Column:
        # The bytes at the end are drawn anew with each attempt, as all are.
        added = F.array_join(F.transform(F.sequence(F.lit(1), more), lambda i: draw(byte("drawn", F.lit(64) - i % 64))), "")
        return F.when(more > 0, added).otherwise("")

    domain = F.substring_index(form, "@", -1)
    tail = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    host = F.substr(domain, F.lit(1), F.length(domain) - F.length(tail))
    email = F.concat(_shaped(F.substring_index(form, "@", 1), "drawn"), longer(lambda n: _from(LETTERS, n)), F.lit("@"), _shaped(host, "drawn_domain"), tail)
    code = F.when(F.startswith(form, F.lit("+")), F.length(F.regexp_extract(form, COUNTRY, 0))).otherwise(
        F.greatest(F.length(form) - 10, F.lit(0))
    )
    phone = F.concat(
        F.substr(form, F.lit(1), code), _from("23456789", at(63)), _shaped(F.substr(form, code + 2), "drawn"),
        longer(lambda n: _from(DIGITS, n)),
    )
    inner = F.concat(F.substr(form, F.lit(1), F.lit(1)), _shaped(F.substr(form, F.lit(2), F.length(form) - 2), "drawn"), longer(lambda n: _from(DIGITS, n)))
    card = F.concat(inner, ((10 - luhn_sum(F.concat(inner, F.lit("0"))) % 10) % 10).cast("string"))
    first = F.substring_index(form, ".", 1)
    # Public stays public: 11 to 126, or 128 to 171.
    public = (at(0) % 160 + F.when(at(0) % 160 < 116, F.lit(11)).otherwise(F.lit(12))).cast("string")
    private = first.isin("10", "127", "0") | form.rlike(r"^(?:192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.")
    kept = (
        F.when(private & (more > NARROW), public).when(private & (more > 0), F.lit("10"))
        .when(first.isin("10", "127", "0"), first).when(form.rlike(r"^192\.168\."), F.lit("192.168"))
        .when(form.rlike(r"^172\.(1[6-9]|2[0-9]|3[01])\."), F.regexp_extract(form, r"^172\.[0-9]+", 0))
        .otherwise(public)
    )
    ip = F.substring_index(F.concat_ws(".", kept, *[at(i).cast("string") for i in (1, 2, 3)]), ".", 4)
    key = F.concat(F.lit("AKIA"), *[_from(BASE32, at(i)) for i in range(16)])
    not_0 = DIGITS[1:]
    ssn = F.concat(
        _from("12345", at(0)), _from(DIGITS, at(1)), _from(DIGITS, at(2)), _from(not_0, at(3)), _from(DIGITS, at(4)),
        _from(not_0, at(5)), *[_from(DIGITS, at(i)) for i in (6, 7, 8)], longer(lambda n: _from(DIGITS, n)),
    )
    country = F.substr(form, F.lit(1), F.lit(2))
    account = F.concat(_shaped(F.substr(form, F.lit(5)), "drawn"), longer(lambda n: _from(DIGITS, n)))
    check = (98 - remainder_97(F.concat(account, country, F.lit("00")))).cast("string")
    iban = F.concat(country, F.lpad(check, 2, "0"), account)
    # The network stays; groups of zeros do too, unless there is no other group or no free value.
    groups = F.split(form, ":")
    bare = F.size(F.filter(F.slice(groups, 2, 7), lambda g: g != "0")) == 0

    def group(g: Column, i: Column) -> Column:
        new = F.concat(_from(HEX[1:], byte("drawn", i * 4)), *[_from(HEX, byte("drawn", i * 4 + j)) for j in (1, 2, 3)])
        return F.when((i > 0) & ((g != "0") | (more > 0) | (bare & (i == 7))), new).otherwise(g)

    ipv6 = F.array_join(F.transform(groups, group), ":")
    start = F.regexp_extract(form, TOKEN_START, 0)
    token = F.concat(start, _shaped(F.substr(form, F.length(start) + 1), "drawn"), longer(lambda n: _from(DIGITS, n)))
    block = F.concat(_shaped(form, "drawn"), longer(lambda n: _from(LETTERS, n)))
    hexes = F.array_join(
        F.transform(F.sequence(F.lit(0), F.greatest(F.length(form) - 1, F.lit(0))), lambda i: _from(HEX, byte("drawn", i))), ""
    )
    hidden = F.when(form.rlike("^[0-9a-f]+$"), F.concat(hexes, longer(lambda n: _from(HEX, n)))).otherwise(
        F.concat(_shaped(form, "drawn"), longer(lambda n: _from(LETTERS, n)))
    )

    def invented(count: int, ending: str | None) -> Column:
        script = script_of(form)
        made = F.lit(None).cast("string")
        for name, syllables in SYLLABLES.items():
            pool = F.array(*[F.lit(s) for s in syllables])
            end = F.lit("") if ending is None else F.lit(ENDINGS[name, ending])
            word = F.concat(*[F.get(pool, (at(2 * i) * 256 + at(2 * i + 1)) % len(syllables)) for i in range(count)], longer(lambda n: F.get(pool, n % len(syllables))), end)
            made = F.when(script == name, word).otherwise(made)
        return made

    return (
        F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip)
        .when(kind == "key", key).when(kind == "ssn", ssn).when(kind == "iban", iban).when(kind == "ipv6", ipv6)
        .when(kind == "token", token).when(kind == "key block", block).when(kind == "secret", hidden)
        .when(kind == "given-f", invented(3, "f")).when(kind == "given-m", invented(3, "m"))
        .when(kind == "given-n", invented(3, "n")).otherwise(invented(4, None))
    )


def surrogates(forms: DataFrame, secret: str) -> DataFrame:
    """Distinct (kind, form) with `made`, different for different forms and no real form of its
    kind. The smallest form of those that collide keeps its surrogate, the others draw again."""
    kind, form = F.col("kind"), F.col("form")
    # Addresses of one domain stay together: the domain is drawn from itself. The draws are
    # written first, or every character would draw anew.
    rows = forms.select(
        "kind", "form", F.lit(0).alias("attempt"), F.lit(None).cast("string").alias("kept"),
        F.when(kind == "email", drawn(secret, F.lit("domain"), F.substring_index(form, "@", -1), F.lit(0))).alias("drawn_domain"),
    )
    # A form takes long for its few bytes, so tasks get forms by number, not by size.
    spread = int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        rows = rows.repartition(spread, "kind", "form")
        rows = store(rows.withColumn("drawn", F.when(F.col("kept").isNull(), drawn(secret, kind, form, F.col("attempt")))), "drawn")
        rows = rows.repartition(spread, "kind", "form")
        made = store(rows.withColumn("made", F.coalesce("kept", surrogate_form(kind, form))), "made")
        holders = made.groupBy("kind", "made").agg(F.min("form").alias("holder"))
        real = forms.select(F.col("kind").alias("k"), F.col("form").alias("f"))
        checked = made.join(holders, ["kind", "made"]).join(real, (kind == F.col("k")) & (F.col("made") == F.col("f")), "left")
        again = (F.col("holder") != form) | F.col("k").isNotNull()
        checked = store(checked.withColumn("again", again).select("kind", "form", "attempt", "made", "drawn_domain", "again"), "checked")
        if checked.where("again").isEmpty():
            return checked.select("kind", "form", "made")
        rows = checked.select(
            "kind", "form", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"),
            F.when(~F.col("again"), F.col("made")).alias("kept"), "drawn_domain",
        )


def _address(value: Column, made: Column) -> Column:
    """An IPv6 address written as `value` is, with its "::"; in full if that has no place for all."""
    groups = F.split(made, ":")
    zeros = lambda of: F.size(F.filter(of, lambda g: g == "0"))
    size = lambda at: F.size(F.filter(F.split(F.element_at(F.split(value, "::"), at), ":"), lambda g: g != ""))
    left, right = F.slice(groups, 1, size(1)), F.slice(groups, 9 - size(-1), size(-1))
    short = F.concat(F.array_join(left, ":"), F.lit("::"), F.array_join(right, ":"))
    return F.when((F.instr(value, "::") > 0) & (zeros(groups) == zeros(groups_of(value))), short).otherwise(made)


def overlaid(kind: Column, value: Column, made: Column) -> Column:
    """The value with its parts replaced by `made` (an array), in the value's own format: its
    separators, its case, its title."""
    single = F.get(made, F.lit(0))
    chars = F.split(value, "")
    number = F.regexp_replace(single, "[^0-9]", "")
    digits = F.array_join(
        F.transform(
            chars,
            lambda c, i: F.when(
                c.rlike("[0-9]"),
                F.substr(number, F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1)),
            ).otherwise(c),
        ), "",
    )
    digits = F.concat(digits, F.substr(number, F.length(F.regexp_replace(value, "[^0-9]", "")) + 1))
    cased = F.array_join(
        F.transform(
            F.split(single, ""),
            lambda c, i: F.when(F.get(chars, i).rlike("[A-Z]"), F.upper(c)).otherwise(c),
        ), "",
    )
    lead = F.regexp_extract(value, LEAD, 0)
    upper = F.regexp_replace(value, LEAD, "").rlike("^(?=.*[A-F])[0-9A-F]{32,}$")
    letters = F.regexp_replace(single, " ", "")
    account = F.concat(
        F.array_join(
            F.transform(
                chars,
                lambda c, i: F.when(c == " ", c).otherwise(
                    F.substr(letters, F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), " ", "")), F.lit(1))
                ),
            ), "",
        ),
        F.substr(letters, F.length(F.regexp_replace(value, " ", "")) + 1),
    )
    address = F.when(value == F.upper(value), F.upper(_address(value, single))).otherwise(_address(value, single))
    block = F.concat(F.regexp_extract(value, f"^{_KEY_START}", 0), single, F.regexp_extract(value, f"{_KEY_END}$", 0))
    names = F.concat_ws(" ", F.concat(F.array(F.regexp_extract(value, r"^\S+", 0)), F.transform(made, lambda m: F.initcap(m))))
    return (
        F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "email", cased).when(kind == "iban", account)
        .when(kind == "ipv6", address).when(kind == "key block", block)
        .when(kind == "secret", F.concat(lead, F.when(upper, F.upper(single)).otherwise(single))).when(kind == "name", names).otherwise(single)
    )


def replacements(found: DataFrame, secret: str) -> DataFrame:
    """From rows with `values` (entities as written): distinct (value, surrogate, number of
    entities in it)."""
    value, kind, piece = F.col("value"), F.col("kind"), F.col("piece")
    values = found.select(F.explode("values").alias("value")).distinct()
    values = values.select("value", F.posexplode(pieces(kind_of(value), value)).alias("at", "p")).select("value", "at", "p.kind", "p.piece")
    values = store(values.withColumn("parts", parts_of(kind, piece)), "entities")
    parts = values.select("value", "at", F.posexplode("parts").alias("pos", "part")).select("value", "at", "pos", "part.kind", "part.form")
    made = surrogates(store(parts.select("kind", "form").distinct(), "forms"), secret)
    per_piece = parts.join(made, ["kind", "form"]).groupBy("value", "at").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "made"))), lambda p: p["made"]).alias("made")
    )
    new = F.when(F.col("made").isNull(), piece).otherwise(overlaid(kind, piece, F.col("made")))
    per_value = values.join(per_piece, ["value", "at"], "left").groupBy("value").agg(
        F.array_sort(F.collect_list(F.struct("at", new.alias("new")))).alias("news"), F.count("made").alias("number")
    )
    return per_value.where("number > 0").select("value", F.array_join(F.col("news.new"), "").alias("surrogate"), "number")


def pseudonymize(docs: DataFrame, text: str = "text", secret: str = "answerflow", counted: str | None = None) -> DataFrame:
    """The rows and columns of `docs` with the entities in `text` replaced, and with `counted`
    a column of that name: how many were replaced in the row.

    Kinds are e-mail addresses, phone and social security numbers, IPv4 and IPv6 addresses, card
    and account numbers (with right check digits), access keys, tokens, private key blocks,
    passwords and other secrets after a keyword (of any length and symbols; letters amid prose
    after a colon are none) or in quotes (hexadecimal), and names of any number of words after a
    title. A later or earlier mention of such a name without its title, of two words or more, gets
    the same surrogate in the same text; if two titled names of a text are alike without their
    titles, the lesser surrogate.

    Null and empty text stays as it is; so does any other column, whatever its name. Texts of any
    length are replaced whole. Repeated rows are replaced alike and come back as often as they are
    there. An empty table gives an empty result.
    """
    names = [f"`{c}`" for c in docs.columns]
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"))
    body = F.col("row").getField(text)
    has = F.coalesce(body.rlike(HINT) & body.rlike(ENTITY), F.lit(False))
    hit = rows.where(has).withColumn("body", body).withColumn("mark", F.sha2("body", 256))
    entities = F.regexp_extract_all("body", F.lit(ENTITY), 0)
    found = store(
        hit.select("mark", F.array_distinct(entities).alias("values")).groupBy("mark").agg(F.first("values").alias("values")), "found"
    )
    # A text has its own replacements: as many as it has entities. A name of several words is the
    # same person without its title too.
    pairs = found.select("mark", F.explode("values").alias("value")).join(replacements(found, secret), "value")
    bare = lambda c: F.regexp_replace(c, r"^\S+ ", "")
    mention = F.when(
        F.col("value").rlike(rf"^(?:{PATTERNS['name']})$") & F.contains(bare(F.col("value")), F.lit(" ")),
        F.struct(bare(F.col("value")).alias("value"), F.lit(1).alias("order"), bare(F.col("surrogate")).alias("surrogate"), F.lit(1).cast("long").alias("number")),
    )
    said = F.struct("value", F.lit(0).alias("order"), "surrogate", "number")
    each = pairs.select("mark", F.explode(F.array_compact(F.array(said, mention))).alias("e")).groupBy("mark", "e.value").agg(
        F.min(F.struct("e.order", "e.surrogate", "e.number")).alias("new")
    )
    names = F.array_sort(F.collect_list(F.when(F.col("new.order") == 1, F.col("value"))), lambda a, b: F.length(b) - F.length(a))
    per_text = each.groupBy("mark").agg(
        F.map_from_entries(F.collect_list(F.struct("value", F.struct("new.surrogate", "new.number")))).alias("known"), names.alias("names")
    )
    quoted = F.array_join(F.transform("names", lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))), "|")
    mentions = F.concat(F.lit(r"|(?<![\p{L}\p{N}_])(?:"), quoted, F.lit(r")(?![\p{L}\p{N}_])"))
    per_text = store(
        per_text.select(F.col("mark").alias("of"), "known", F.when(F.size("names") > 0, mentions).otherwise("").alias("mentions")), "per-text"
    )
    pattern = F.concat(F.lit(ENTITY), F.coalesce("mentions", F.lit("")))
    entities = F.regexp_extract_all("body", pattern, 0)
    gaps = F.split("body", pattern, -1)
    swapped = F.array_join(
        F.flatten(F.zip_with(gaps, entities, lambda g, e: F.array(g, F.coalesce(F.try_element_at(F.col("known"), F.coalesce(e, F.lit("")))["surrogate"], e, F.lit(""))))), ""
    )
    number = F.aggregate(entities, F.lit(0).cast("long"), lambda n, e: n + F.coalesce(F.try_element_at(F.col("known"), e)["number"], F.lit(0)))
    known = hit.join(per_text, F.col("mark") == F.col("of"), "left")
    known = known.withColumn("known", F.coalesce("known", F.create_map().cast("map<string,struct<surrogate:string,number:bigint>>")))
    fields = {c: F.col("row").getField(c) for c in docs.columns}
    plain = rows.where(~has).select(*[f.alias(c) for c, f in fields.items()], *([F.lit(0).cast("long").alias(counted)] if counted else []))
    done = known.select("row", swapped.alias("swapped"), number.alias("number"))
    changed = done.select(
        *[(F.col("swapped") if c == text else f).alias(c) for c, f in fields.items()],
        *([F.col("number").alias(counted)] if counted else []),
    )
    return plain.unionAll(changed)
