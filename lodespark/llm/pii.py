"""Format-preserving pseudonyms for personal data, in SQL expressions only.

Numbers and dates that pass their format's own check are permuted within the format
by a keyed Feistel network: two parts, one counted modulo a and the other modulo b,
take turns in being shifted by a keyed hash of the other, so each of the a * b values
goes to one other, and equal values stay equal in all documents. Where only some of
the values are valid, the permutation is applied until it meets a valid one again
(cycle walking), which keeps it one to one. Digits go back to their places between
the separators.

Formats: cards (13 to 19 digits, Luhn; the last digit is worked out anew), IPv4
addresses, social security numbers (area, group and serial), North American telephone
numbers, other international ones from + on (their first two digits stay), IBANs
(check digits; letters stay), and dates of the years 1600 to 2399: yyyy-MM-dd, also
before T and a time, dd/MM/yyyy and dd.MM.yyyy, which share one permutation, and
MM/dd/yyyy where it can't be dd/MM/yyyy, which has one of its own, as pseudonyms of
both readings could meet otherwise. Mail addresses and hexadecimal secrets have no
numbering to permute; they become keyed digests in their format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import unused

ROUNDS = 10
#: Steps of cycle walking at most. Over half of the values are valid in each format, so a walk that is not over by then has odds of 2^-64.
WALK = 64
#: 800 years from 1600-03-01 on, two full cycles of the calendar: 378 * 773 days.
FIRST_DAY, DAYS = "1600-03-01", (378, 773)

EDGE, OPEN = r"(?![0-9A-Za-z])", r"(?<![0-9A-Za-z])"
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET = OPEN + r"[0-9A-Fa-f]{32,64}" + EDGE
IBAN = OPEN + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + EDGE
ISO_DATE = r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?!(?!T[0-9]{2}:)[0-9A-Za-z-])"
SLASH_DATE = r"(?<![0-9A-Za-z/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9A-Za-z/])"
DOT_DATE = r"(?<![0-9A-Za-z.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9A-Za-z]|\.[0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+1[0-9]{10}|(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})" + EDGE
ABROAD = r"(?<![0-9A-Za-z+])\+[2-9](?:[0-9]{7,14}|[0-9]{0,2}(?:[ .-][0-9]{2,4}){2,5})" + EDGE
CARD = OPEN + r"(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + EDGE
ADDRESS = r"(?<![0-9A-Za-z.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
ANY = "|".join((MAIL, SECRET, IBAN, ISO_DATE, SLASH_DATE, DOT_DATE, SSN, PHONE, ABROAD, CARD, ADDRESS))
KINDS = ("mail", "secret", "iban", "date", "ssn", "phone", "card", "address")


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def keyed(key: str, *parts: str) -> str:
    """Hexadecimal digest of the parts under the key."""
    inner = ", ".join((quoted(key), *parts))
    return f"sha2(concat_ws(':', {quoted(key)}, sha2(concat_ws(':', {inner}), 256)), 256)"


def parts(value: str, b: str) -> str:
    """SQL for the two parts of a bigint, the second one under ``b``."""
    return f"named_struct('l', ({value}) div ({b}), 'r', pmod({value}, {b}))"


def shuffled(state: str, a: str, b: str, kind: str, key: str, valid: Callable[[str], str] | None = None) -> str:
    """SQL for the keyed permutation of (l, r), l under a and r under b; with ``valid``, of those pairs that it holds for, of which ``state`` is one."""
    shift = lambda part: f"cast(conv(substr({keyed(key, quoted(kind), a, b, 'i', part)}, 1, 12), 16, 10) as bigint)"
    once = lambda x: f"""aggregate(sequence(0, {ROUNDS - 1}), {x},
      (s, i) -> if(i % 2 = 0, named_struct('l', pmod(s.l + {shift("s.r")}, {a}), 'r', s.r), named_struct('l', s.l, 'r', pmod(s.r + {shift("s.l")}, {b}))))"""  # noqa: E731
    return f"aggregate(sequence(1, {WALK}), {once(state)}, (x, j) -> if({valid('x')}, x, {once('x')}))" if valid else once(state)


def permuted(value: str, a: str, b: str, kind: str, key: str, valid: Callable[[str], str] | None = None) -> str:
    """SQL for the place of ``value``, a bigint under a * b, in the keyed permutation of a * b values."""
    return f"transform(array({shuffled(parts(value, b), a, b, kind, key, valid)}), s -> s.l * ({b}) + s.r)[0]"


def permuted_digits(digits: str, kind: str, key: str, valid: Callable[[str], str] | None = None) -> str:
    """SQL for a string of 2 to 36 digits permuted among those of its length."""
    n = f"length({digits})"
    a, b = (f"cast(pow(10, {half}) as bigint)" for half in (f"{n} div 2", f"{n} - {n} div 2"))
    state = f"named_struct('l', cast(substr({digits}, 1, {n} div 2) as bigint), 'r', cast(substr({digits}, {n} div 2 + 1) as bigint))"
    both = f"concat(lpad(cast(s.l as string), {n} div 2, '0'), lpad(cast(s.r as string), {n} - {n} div 2, '0'))"
    return f"transform(array({shuffled(state, a, b, kind, key, valid)}), s -> {both})[0]"


def weighed(digits: str, doubled: int) -> str:
    """SQL for the Luhn sum of digits, counted from the right; doubled: whether the odd (1) or even (0) places count twice."""
    one = f"cast(substr(reverse({digits}), j, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (t, j) -> t + if(j % 2 = {doubled}, {one} * 2 - if({one} > 4, 9, 0), {one}))"


def only_digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def refilled(value: str, digits: str) -> str:
    """SQL for ``value`` with its digits replaced by others, in order."""
    return f"array_join(transform(split({value}, ''), (c, k) -> if(c rlike '^[0-9]$', substr({digits}, length({only_digits(f'substr({value}, 1, k + 1)')}), 1), c)), '')"


def social(x: str) -> str:
    """Whether nine digits, in parts of four and five, are a social security number that may be given out."""
    area, group, serial = f"({x}.l div 10)", f"({x}.l % 10 * 10 + {x}.r div 10000)", f"({x}.r % 10000)"
    return f"{area} not in (0, 666) and {area} < 900 and {group} > 0 and {serial} > 0"


def dialled(x: str) -> str:
    """Whether ten digits, in two parts, have an area and an exchange that begin with 2 to 9."""
    return f"({x}.l >= 20000 and {x}.l div 10 % 10 >= 2)"


def check_digits(country: str, own: str) -> str:
    """SQL for the two check digits of an IBAN of a country and an account."""
    code = "ascii(substr(t, k, 1))"
    step = f"pmod(if({code} >= 65, n * 100 + {code} - 55, n * 10 + {code} - 48), 97)"
    rest = f"transform(array(concat({own}, {country}, '00')), t -> aggregate(sequence(1, length(t)), 0, (n, k) -> {step}))[0]"
    return f"lpad(cast(98 - {rest} as string), 2, '0')"


def pseudonym(v: str, key: str) -> str:
    """SQL for (kind, text) of a match ``v``; kind is null where it fails its check, and the text then stays."""
    d = only_digits(v)
    octets = f"transform(split({v}, '[.]'), o -> cast(o as bigint))"
    number = f"aggregate({octets}, 0L, (n, o) -> n * 256 + o)"
    new_address = f"transform(array({permuted(number, '65536L', '65536L', 'address', key)}), n -> concat_ws('.', n div 16777216, pmod(n div 65536, 256), pmod(n div 256, 256), pmod(n, 256)))[0]"
    card = f"substr({d}, 1, length({d}) - 1)"
    new_card = f"transform(array({permuted_digits(card, 'card', key)}), p -> concat(p, pmod(10 - {weighed('p', 1)} % 10, 10)))[0]"
    phone = f"right({d}, 10)"
    like = f"(substr({phone}, 1, 1) >= '2' and substr({phone}, 4, 1) >= '2')"
    new_phone = f"concat(substr({d}, 1, length({d}) - 10), {permuted_digits(phone, 'phone', key, lambda x: f'{dialled(x)} = {like}')})"
    new_abroad = f"concat(substr({d}, 1, 2), {permuted_digits(f'substr({d}, 3)', 'abroad', key)})"
    a, b = DAYS
    read = lambda form: f"datediff(cast(try_to_timestamp({v}, '{form}') as date), date'{FIRST_DAY}')"
    inside = lambda form: f"cast({read(form)} as bigint) between 0 and {a * b - 1}"
    day = lambda n: f"date_add(date'{FIRST_DAY}', cast({n} as int))"
    new_date = lambda form, kind, valid=None: f"date_format({day(permuted(f'cast({read(form)} as bigint)', f'{a}L', f'{b}L', kind, key, valid))}, '{form}')"
    late = lambda x: f"day({day(f'{x}.l * {b} + {x}.r')}) > 12"
    bare = f"replace({v}, ' ', '')"
    country, own = f"substr({bare}, 1, 2)", f"substr({bare}, 5)"
    account = permuted_digits(only_digits(own), "iban", key)
    new_iban = f"transform(array({account}), p -> {refilled(v, f'concat({check_digits(country, refilled(own, "p"))}, p)')})[0]"
    hashed = keyed(key, quoted("mail"), f"lower({v})")
    secret = f"substr(concat({keyed(key, quoted('secret'), f'lower({v})')}, {keyed(key, quoted('more'), f'lower({v})')}), 1, length({v}))"
    slash = f"{v} rlike '^[0-9]{{2}}/'"
    cases = (
        ("mail", f"{v} rlike '@'", f"concat(substr({hashed}, 1, 12), '@', substr({hashed}, 13, 8), '.invalid')"),
        ("secret", f"{v} rlike '^[0-9A-Fa-f]{{32,64}}$' and {v} rlike '[0-9]' and {v} rlike '[A-Fa-f]'", f"if({v} = upper({v}), upper({secret}), {secret})"),
        ("iban", f"{v} rlike '^[A-Z]{{2}}' and length({only_digits(own)}) >= 2 and substr({bare}, 3, 2) = {check_digits(country, own)}", new_iban),
        ("date", f"{v} rlike '^[0-9]{{4}}-' and {inside('yyyy-MM-dd')}", new_date("yyyy-MM-dd", "date")),
        ("date", f"{slash} and {inside('dd/MM/yyyy')}", new_date("dd/MM/yyyy", "date")),
        ("date", f"{slash} and try_to_timestamp({v}, 'dd/MM/yyyy') is null and {inside('MM/dd/yyyy')}", new_date("MM/dd/yyyy", "month first", late)),
        ("date", f"{v} rlike '^[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}$' and {inside('dd.MM.yyyy')}", new_date("dd.MM.yyyy", "date")),
        ("ssn", f"{v} rlike '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}$'", refilled(v, permuted_digits(d, "ssn", key, social))),
        ("phone", f"{v} rlike {quoted('^(?:' + PHONE + ')$')}", refilled(v, new_phone)),
        ("phone", f"{v} rlike '^[+]' and length({d}) between 8 and 15", refilled(v, new_abroad)),
        ("card", f"{v} rlike '^[0-9][0-9 -]+$' and length({d}) between 13 and 19 and {weighed(d, 0)} % 10 = 0", refilled(v, new_card)),
        ("address", f"{v} rlike '^[0-9]+[.]' and forall({octets}, o -> o < 256)", new_address),
    )
    return "case " + " ".join(f"when {test} then named_struct('kind', '{kind}', 'text', {made})" for kind, test, made in cases) + f" else named_struct('kind', cast(null as string), 'text', {v}) end"


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in the text, and a column pii_kinds of what was replaced.

    Null texts stay null and empty texts empty, with no kinds; texts of any length are
    taken whole. Rows that repeat are treated alike. All other columns stay, whatever
    their names, but pii_kinds is replaced. ``key`` decides the permutation and must be
    given; keep it secret, and the same wherever values are to stay linked."""
    if not key:
        raise ValueError("a key is needed")
    keep = [c for c in docs.columns if c != "pii_kinds"]
    found_col, made_col = unused(docs, "found", "made")
    name = f"`{text_col}`"
    found = f"regexp_extract_all({name}, {quoted(ANY)}, 0)"
    hot = f"{name} rlike '[0-9@]'"
    step = docs.select(*(f"`{c}`" for c in keep), F.expr(f"if({hot}, {found}, null)").alias(found_col))
    step = step.withColumn(made_col, F.expr(f"if(size({found_col}) > 0, transform({found_col}, v -> {pseudonym('v', key)}), null)"))
    text = F.expr(f"if({made_col} is null, {name}, array_join(flatten(zip_with(split({name}, {quoted(ANY)}, -1), {made_col}, (gap, m) -> array(gap, coalesce(m.text, '')))), ''))")
    kinds = F.expr(f"coalesce(filter(transform({made_col}, m -> m.kind), k -> k is not null), cast(array() as array<string>))")
    return step.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in keep], kinds.alias("pii_kinds"))


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonyms under the session's key, or without one under a key that only serves the test tables."""
    key = spark.conf.get("spark.lodespark.pii.key", "for test tables")
    out = pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key)
    kinds = F.array_join(F.array_sort(F.array_distinct("pii_kinds")), ",")
    return out.select("doc_id", F.size("pii_kinds").cast("bigint").alias("n_replaced"), kinds.alias("kinds"), "text")


QUERIES = {"op7_pii_pseudonyms": op7_pii_pseudonyms}
ORACLE: dict[str, str] = {}
