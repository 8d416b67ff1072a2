"""Personal data: detected entities receive keyed surrogates of their own kind, form and gender.

Detection is one pattern over the text. What it finds becomes entities: a kind
and a canonical form in which spelling variants meet, so that one entity has one
surrogate wherever it stands (coreference). A surrogate is made from a keyed
hash of the entity. All distinct entities are then checked together: a surrogate
that a second entity has too, or that is itself a detected entity, is made again
with the next attempt number, until no two entities share one (distinctness).

Surrogates are written in the form of the entity they stand for: digits at the
places of digits, letters at those of letters with their case, names of the
gender of the title and of the script of the name. Everything is DataFrame
functions. Only texts with an entity are moved; the others pass as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm import common

KEY = "surrogates"

_MALE = "Mr|Herr|Monsieur|Señor|Sr|Don|Господин|г-н"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Señora|Señorita|Sra|Doña|Госпожа|г-жа"
_NEUTRAL = "Dr|Prof"
TITLE = rf"(?<![\p{{L}}\p{{N}}])(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.?"
_NAME = r"\p{Lu}[\p{Ll}\p{Lu}\p{M}'’-]*\p{Ll}"

# One alternative for each kind; the more specific come first. No part can be tried
# again from the middle of what it has read, so a long run of characters is read once.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\d-])"
PHONE = (
    r"(?<![\p{L}\d+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
    # Seven digits or more: "+100" and "+150 (20)" are none.
    r"|(?<![\p{L}\d+])(?=\+\d(?:\)?[ .-]?\(?\d){6})\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,7}(?!\d)"
)
IBAN = r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])"
NAME = rf"{TITLE}\s{_NAME}(?: {_NAME})?"
PATTERN = f"(?:{EMAIL})|(?:{IP})|(?:{SSN})|(?:{CARD})|(?:{IBAN})|(?:{PHONE})|(?:{NAME})"

# Without one of these characters or a title there is no match: read first, as it is cheap.
_MAYBE = rf"[0-9@]|(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.?\s"

_LATIN = "ba be bi bo da de di do fa fe ga go ja jo ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe po ra re ri ro sa se si so ta te ti to va vi".split()
_CYRILLIC = "ба бе би бо ва ве ви во да де ди до за зе зи зо ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то".split()
# Endings by script and gender; a surname has its own in any case.
_ENDINGS = {
    ("latin", "m"): ["rik", "ton", "us", "mir"], ("latin", "f"): ["lina", "ria", "nette", "sa"],
    ("latin", "n"): ["ris", "ley", "kin", "ran"], ("latin", "s"): ["berg", "son", "well", "ard"],
    ("cyrillic", "m"): ["слав", "мир", "рий", "тон"], ("cyrillic", "f"): ["лина", "рия", "ния", "са"],
    ("cyrillic", "n"): ["ран", "ким", "рис", "лей"], ("cyrillic", "s"): ["енко", "ич", "юк", "ман"],
}
# Attempts with which a number has the length of the entity; each later one writes one digit more.
SAME_LENGTH = 4
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _byte(h: Column, i: Column) -> Column:
    """Number 0 to 255 at place i, from 0, of a hash in hex; the hash repeats."""
    return F.conv(F.substring(h, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(items: list[str], number: Column) -> Column:
    return F.get(F.split(F.lit(" ".join(items)), " "), F.pmod(number, F.lit(len(items))))


def _digits(h: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.pmod(_byte(h, i), F.lit(10)).cast("string")), "")


def _reshaped(h: Column, form: Column) -> Column:
    """Letters and digits of `form` replaced by keyed ones, all else as it is."""
    chars = F.filter(F.split(form, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, i: (
        F.when(c.between("a", "z"), F.substring(F.lit(_LETTERS), F.pmod(_byte(h, i), F.lit(26)) + 1, F.lit(1)))
        .when(c.between("A", "Z"), F.upper(F.substring(F.lit(_LETTERS), F.pmod(_byte(h, i), F.lit(26)) + 1, F.lit(1))))
        .when(c.between("0", "9"), F.pmod(_byte(h, i), F.lit(10)).cast("string")).otherwise(c))), "")


def _luhn(fifteen: Column) -> Column:
    """Fifteen digits and the check digit of a card number."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda s, i: s + F.when(
        i % 2 == 1, F.get(F.split(F.lit("0 2 4 6 8 1 3 5 7 9"), " ").cast("array<int>"), F.substring(fifteen, i, F.lit(1)).cast("int"))
    ).otherwise(F.substring(fifteen, i, F.lit(1)).cast("int")))
    return F.concat(fifteen, F.pmod(10 - total % 10, F.lit(10)).cast("string"))


def _name(h: Column, canon: Column, attempt: Column, sort: str) -> Column:
    """Three syllables, one more with each attempt, and an ending; each attempt draws from a new hash."""
    def of(script: str, syllables: list[str]) -> Column:
        drawn = F.transform(F.sequence(F.lit(0), attempt + 2), lambda i: _pick(
            syllables, _byte(h, i) + 256 * _byte(h, i + 8)))
        return F.concat(F.array_join(drawn, ""), _pick(_ENDINGS[script, sort], _byte(h, F.lit(20))))

    return F.when(canon.rlike(r"\p{IsCyrillic}"), of("cyrillic", _CYRILLIC)).otherwise(of("latin", _LATIN))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str = KEY) -> Column:
    """The canonical form of the surrogate of an entity.

    No kind has a fixed number of surrogates: names and local parts grow with each
    attempt, numbers from the attempt SAME_LENGTH on.
    """
    h = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")), 512)
    more = F.greatest(attempt - (SAME_LENGTH - 1), F.lit(0))
    # Digits of a longer number, from the far end of the hash.
    longer = F.when(more > 0, F.array_join(F.transform(
        F.sequence(F.lit(0), F.greatest(more - 1, F.lit(0))), lambda i: F.pmod(_byte(h, 63 - i), F.lit(10)).cast("string")), "")).otherwise("")
    letters = F.when(attempt > 0, F.array_join(F.transform(
        F.sequence(F.lit(0), F.greatest(attempt - 1, F.lit(0))), lambda i: F.substring(F.lit(_LETTERS), F.pmod(_byte(h, 63 - i), F.lit(26)) + 1, F.lit(1))), "")).otherwise("")
    octets = F.array_join(F.transform(F.sequence(F.lit(0), more + 3), lambda i: (F.pmod(_byte(h, i), F.lit(254)) + 1).cast("string")), ".")
    parts = F.split(canon, "@")
    domain = F.regexp_extract(parts[1], r"^(.*)(\.[^.]*)$", 1)
    return (
        F.when(kind == "email", F.concat(
            _reshaped(h, parts[0]), letters, F.lit("@"),
            # One domain has one surrogate, but for an address that has to be drawn again.
            _reshaped(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), parts[1], F.when(attempt > 0, attempt.cast("string"))), 512), domain),
            F.regexp_extract(parts[1], r"(\.[^.]*)$", 1)))
        .when(kind == "ip", octets)
        .when(kind == "card", F.concat(longer, _luhn(F.concat((F.pmod(_byte(h, F.lit(40)), F.lit(5)) + 2).cast("string"), _digits(h, 14)))))
        .when(kind == "phone", F.concat(longer, (F.pmod(_byte(h, F.lit(40)), F.lit(8)) + 2).cast("string"), _digits(h, F.length(canon) - 1)))
        .when(kind == "ssn", F.concat(F.lit("9"), longer, _digits(h, 8)))
        .when(kind == "iban", F.concat(F.substring(canon, 1, 2), _reshaped(h, F.substring(canon, F.lit(3), F.length(canon))), longer))
        .when(kind == "given_m", _name(h, canon, attempt, "m")).when(kind == "given_f", _name(h, canon, attempt, "f"))
        .when(kind == "given_n", _name(h, canon, attempt, "n")).otherwise(_name(h, canon, attempt, "s"))
    )


def kind_of(hit: Column) -> Column:
    return (
        F.when(hit.contains("@"), "email").when(hit.rlike(rf"^(?:{IP})$"), "ip").when(hit.rlike(rf"^(?:{SSN})$"), "ssn")
        .when(hit.rlike(rf"^(?:{CARD})$"), "card").when(hit.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(hit.rlike(r"^[+(\d]"), "phone").otherwise("name")
    )


def entities(hit: Column, kind: Column) -> Column:
    """The entities of a detected string of this kind: array<struct<kind, canon>>; a name has one or two."""
    digits = F.regexp_replace(hit, r"\D", "")
    title = F.regexp_extract(hit, rf"^({TITLE})\s", 1)
    first = F.regexp_extract(hit, rf"^{TITLE}\s({_NAME}) {_NAME}$", 1)
    last = F.regexp_extract(hit, rf"({_NAME})$", 1)
    gender = (
        F.when(title.rlike(rf"^(?:{_FEMALE})\.?$"), "f").when(title.rlike(rf"^(?:{_MALE})\.?$"), "m").otherwise("n"))
    canon = (
        F.when(kind == "email", F.lower(hit)).when(kind == "ip", hit)
        .when(kind == "phone", F.substring(digits, F.greatest(F.length(digits) - 9, F.lit(1)), F.lit(10)))
        .when(kind == "iban", F.regexp_replace(hit, " ", "")).otherwise(digits))

    def one(k: Column, c: Column) -> Column:
        return F.struct(k.alias("kind"), c.alias("canon"))

    given = F.when(first != "", one(F.concat(F.lit("given_"), gender), F.lower(first)))
    named = F.array_compact(F.array(given, one(F.lit("surname"), F.lower(last))))
    return F.when(kind == "name", named).otherwise(F.array(one(kind, canon)))


def _filled(hit: Column, canon: Column, kind: Column) -> Column:
    """The digits of `canon`, from the right, at the digits of `hit`; earlier ones (a country code) stay.

    What `canon` has more than the entity stands before its first digit.
    """
    chars = F.filter(F.split(hit, ""), lambda c: c != "")
    digits = F.length(F.regexp_replace(hit, r"\D", ""))
    own = F.when(kind == "phone", F.least(digits, F.lit(10))).otherwise(digits)
    surplus = F.greatest(F.length(canon) - own, F.lit(0))
    state = F.aggregate(
        F.reverse(chars), F.struct(F.length(canon).alias("left"), F.lit("").alias("out")),
        lambda s, c: F.when(c.between("0", "9") & (s["left"] > surplus + 1), F.struct(
            (s["left"] - 1).alias("left"), F.concat(F.substring(canon, s["left"], F.lit(1)), s["out"]).alias("out"))
        ).when(c.between("0", "9") & (s["left"] > 0), F.struct(
            F.lit(0).alias("left"), F.concat(F.substring(canon, F.lit(1), s["left"]), s["out"]).alias("out"))
        ).otherwise(F.struct(s["left"].alias("left"), F.concat(c, s["out"]).alias("out"))))
    return state["out"]


def _cased(name: Column, like: Column) -> Column:
    return F.when((like == F.upper(like)) & (F.length(like) > 1), F.upper(name)).otherwise(F.initcap(name))


def _spaced(hit: Column, canon: Column) -> Column:
    """`canon` with the spaces of `hit`; what it has more than the entity comes last."""
    chars = F.filter(F.split(hit, ""), lambda c: c != "")
    state = F.aggregate(
        chars, F.struct(F.lit(1).alias("at"), F.lit("").alias("out")),
        lambda s, c: F.when(c == " ", F.struct(s["at"].alias("at"), F.concat(s["out"], c).alias("out"))).otherwise(
            F.struct((s["at"] + 1).alias("at"), F.concat(s["out"], F.substring(canon, s["at"], F.lit(1))).alias("out"))))
    return F.concat(state["out"], F.substring(canon, state["at"], F.length(canon)))


def rendered(hit: Column, kind: Column, found: Column) -> Column:
    """The text that stands for `hit`, from the canonical surrogates of its entities."""
    first = F.regexp_extract(hit, rf"^{TITLE}\s({_NAME}) {_NAME}$", 1)
    last = F.regexp_extract(hit, rf"({_NAME})$", 1)
    title = F.regexp_extract(hit, rf"^({TITLE}\s)", 1)
    return (
        F.when(kind.isin("email", "ip"), found[0]).when(kind == "iban", _spaced(hit, found[0]))
        .when(kind != "name", _filled(hit, found[0], kind))
        .when(F.size(found) > 1, F.concat(title, _cased(found[0], first), F.lit(" "), _cased(F.get(found, F.lit(1)), last)))
        .otherwise(F.concat(title, _cased(found[0], last)))
    )


def surrogate_table(known: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, surrogate) for distinct entities (kind, canon), no two surrogates of a kind equal.

    In each round the entity of least canonical form keeps a surrogate that
    several drew; the others, and those that drew a detected entity, draw again.
    """
    known = common.stored(known.select("kind", "canon").distinct(), "pii-entities")
    open_, taken, attempt = known, None, 0
    while True:
        drawn = common.stored(
            open_.withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), F.lit(attempt), key)), "pii-drawn")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        good = first.join(known.select("kind", F.col("canon").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if taken is not None:
            good = good.join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        good = common.stored(good.select("kind", "canon", "surrogate"), "pii-good")
        taken = good if taken is None else taken.union(good)
        open_ = common.stored(drawn.join(good, ["kind", "canon"], "left_anti").select("kind", "canon"), "pii-open")
        if open_.isEmpty():
            return taken
        attempt += 1


def replace(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """`docs` with every detected entity replaced, and n_entities, the number of detected strings.

    A null or empty text stays as it is with 0. Rows may repeat; row order is not
    kept. Internal columns begin with `_pii`; a column n_entities gives way.
    """
    docs = docs.drop("n_entities")
    columns = docs.columns
    body = F.col(f"`{text}`")
    some = F.coalesce(body.rlike(_MAYBE) & body.rlike(PATTERN), F.lit(False))
    rows = common.stored(
        docs.where(some).withColumns({
            "_pii_hits": F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0)),
            "_pii_gaps": F.split(body, PATTERN, -1), "_pii_row": F.monotonically_increasing_id(),
        }).drop(text), "pii-rows")
    # Kinds and entities are columns of a stored row for each detected string, worked out once.
    hits = rows.select("_pii_row", F.posexplode("_pii_hits").alias("at", "hit")).withColumn("kind", kind_of(F.col("hit")))
    hits = common.stored(hits.withColumn("parts", entities(F.col("hit"), F.col("kind"))), "pii-hits")
    parts = hits.select("_pii_row", "at", F.posexplode("parts").alias("part", "entity")).select(
        "_pii_row", "at", "part", "entity.kind", "entity.canon")
    table = surrogate_table(parts, key)
    # What comes together is of one text, never of one entity: a frequent one is split by the join.
    drawn = parts.join(table, ["kind", "canon"]).groupBy("_pii_row", "at").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("part", "surrogate"))), lambda e: e["surrogate"]).alias("found"))
    written = hits.select("_pii_row", "at", "hit", "kind").join(drawn, ["_pii_row", "at"]).select(
        "_pii_row", "at", rendered(F.col("hit"), F.col("kind"), F.col("found")).alias("new"))
    per_row = common.stored(written.groupBy("_pii_row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda e: e["new"]).alias("_pii_new")), "pii-new")
    whole = F.array_join(F.transform(
        "_pii_gaps", lambda g, i: F.concat(g, F.coalesce(F.get("_pii_new", i), F.lit("")))), "")
    done = rows.join(per_row, "_pii_row").withColumn(text, whole).select(
        *[F.col(f"`{c}`") for c in columns], F.size("_pii_hits").cast("bigint").alias("n_entities"))
    return done.unionByName(docs.where(~some).withColumn("n_entities", F.lit(0).cast("bigint")))
