"""Surrogates for personal data and secrets [DataFrame functions only].

One expression finds the entities of a text; names found behind a title are then looked for in the rest of the same text
too, so that every mention of a person changes alike. Each part is replaced by a keyed function (HMAC-SHA-256) of its kind
and value, so equal values get equal surrogates everywhere: digits become digits, letters letters of the same case,
hexadecimal stays so; addresses, numbers and keys keep their format, cards their check digit, and names their script and,
by the title before them, their gender. Domains change but for their public suffix and the names reserved for examples. A
check over all distinct parts finds surrogates that two values would share or that are some part's real value; those
values get the function's next outcome. From the turn WIDER on outcomes grow longer by turn, so there are enough for any
number of values.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, settle

#: The session's setting that holds the key; where it is unset each session draws its own.
KEY = "spark.strataframe.pii.key"
WIDER = 3
_drawn_keys: dict[str, str] = {}
MALE, FEMALE = "Mr|Herr|Monsieur|Señor|Sr|г-н", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|г-жа"
WORD = r"\p{Lu}[\p{L}'’-]{1,30}"
#: A local part is a whole run of its characters, from where it begins or the last entity ends, so long runs are read once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
SECRET = r'(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)) {0,3}[=:] {0,3}["' + r"']?[A-Za-z0-9+/_-]{8,}+"
CLOUD_KEY = r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
ADDRESS = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)"
ACCOUNT = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
PERSON_NUMBER = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{3,4}(?![\w-])"
NAME = rf"(?:\b(?:{FEMALE}|{MALE}|Dr|Prof)\.? ){WORD}(?: {WORD})?"
ANY = "|".join([EMAIL, SECRET, CLOUD_KEY, ADDRESS, PERSON_NUMBER, CARD, ACCOUNT, PHONE, NAME])
#: Texts without any of these hold no entity.
HINT = rf"\d|@|\b(?:{FEMALE}|{MALE}|Dr|Prof)\.? |AKIA|ASIA|(?i:password|passwd|pwd|secret|token|key)"

#: Texts without this hold no titled name.
TITLED = rf"\b(?:{FEMALE}|{MALE}|Dr|Prof)\.? \p{{Lu}}"

SYLLABLES = ["ba", "de", "fi", "go", "lu", "ma", "ne", "ri", "so", "ta", "ve", "zo", "ka", "mi", "no", "pe"]
CYRILLIC = ["ба", "де", "фи", "го", "лу", "ма", "не", "ри", "со", "та", "ве", "зо", "ка", "ми", "но", "пе"]


def session_key(spark: SparkSession) -> str:
    """The key of KEY, or one that is drawn for this application and kept in the driver's memory alone."""
    own = spark.conf.get(KEY, None)
    return own or _drawn_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-256 in hexadecimal digits."""
    block = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    pad = lambda x: F.lit(bytes(c ^ x for c in block.ljust(64, b"\0")))
    inner = F.sha2(F.concat(pad(0x36), message.cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def _stream(kind: Column, core: Column, turn, key: str) -> Column:
    """128 hexadecimal digits of the keyed hash of a part."""
    base = F.concat_ws("\u0000", kind, core, F.lit(str(turn)))
    return F.concat(_hmac(key, base), _hmac(key, F.concat(base, F.lit("+"))))


def _drawn(stream: Column, i: Column, n: int) -> Column:
    """The i-th number below n."""
    return F.conv(F.substring(stream, (i * 2) % 126 + 1, F.lit(3)), 16, 10).cast("int") % n


def _like(value: Column, stream: Column, hexadecimal: bool = False) -> Column:
    """Each letter and digit replaced by one of its class, all else kept."""
    pick = lambda s, i: F.substring(F.lit(s), _drawn(stream, i, len(s)) + 1, F.lit(1))
    low, up = ("abcdef", "ABCDEF") if hexadecimal else ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    swap = lambda c, i: F.when(c.between("0", "9"), pick("0123456789", i)).when(c.between("a", "z"), pick(low, i)).when(c.between("A", "Z"), pick(up, i)).otherwise(c)
    return F.array_join(F.transform(F.split(value, ""), swap), "")


def _name(core: Column, kind: Column, stream: Column, extra: int) -> Column:
    def made(parts, male, female):
        s = F.concat(*[F.element_at(F.array(*map(F.lit, parts)), _drawn(stream, F.lit(1 + 4 * k), len(parts)) + 1) for k in range(4 + extra)])
        return F.concat(F.initcap(s), F.when(kind == "given, male", male).when(kind == "given, female", female).otherwise("" if parts is SYLLABLES else "в"))

    return F.when(core.rlike(r"\p{IsCyrillic}"), made(CYRILLIC, "н", "я")).otherwise(made(SYLLABLES, "n", "na"))


def _luhn(digits: Column) -> Column:
    """The check sum of a string of digits, a multiple of ten where the last one is the check digit."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c > "4", 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _bare(core: Column) -> Column:
    return F.translate(core, " -", "")


def _checked(core: Column) -> Column:
    """A card number with its last digit set so that the check sum holds."""
    head = F.substring(core, F.lit(1), F.length(core) - 1)
    off = _luhn(F.concat(_bare(head), F.lit("0"))) % 10
    return F.concat(head, ((10 - off) % 10).cast("string"))


#: Names that RFC 2606 reserves for examples belong to nobody.
RESERVED = r"((?:^|(?<=\.))(?:example\.(?:com|net|org)|[A-Za-z0-9-]+\.(?:example|test|invalid|localhost)))$"
PUBLIC = r"((?:\.(?:co|com|org|net|ac|gov|edu))?\.[A-Za-z0-9-]+)$"


def _kept_end(domain: Column) -> Column:
    """The end of a domain that stays: a reserved name, or else the public suffix."""
    reserved = F.regexp_extract(domain, "(?i)" + RESERVED, 1)
    return F.when(reserved != "", reserved).otherwise(F.regexp_extract(domain, "(?i)" + PUBLIC, 1))


def surrogate(kind: Column, core: Column, turn: int = 0, key: str | None = None) -> Column:
    """The surrogate of a part at the given turn, by default with the active session's key."""
    s = _stream(kind, core, turn, key or session_key(SparkSession.active()))
    extra = max(0, turn - WIDER)
    more = lambda c: F.concat(c, F.lit("0" * extra)) if extra else c  # noqa: E731 - places that _like fills
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_drawn(s, i * 3, 254) + 1).cast("string")), ".")
    port = F.concat(F.lit(":"), _like(F.lit("0" * extra), s)) if extra else F.lit("")
    tail = lambda n: F.concat(F.substring(core, 1, n), _like(more(F.substring(core, n + 1, 1000)), s))
    lead = F.regexp_extract(core, r"^(\+\d{1,3}(?=[ .(-]))?", 1)
    end = _kept_end(core)
    return (
        F.when(kind == "domain", F.concat(_like(more(F.substring(core, F.lit(1), F.length(core) - F.length(end) - F.when(end.startswith("."), 0).otherwise(1))), s), F.when(end.startswith("."), "").otherwise("."), end))
        .when(kind == "address", F.concat(octets, port))
        .when(kind == "cloud key", tail(4))
        .when(kind == "account", tail(2))
        .when(kind == "card", _checked(tail(1)))
        .when(kind == "phone", F.concat(lead, _like(more(F.substring(core, F.length(lead) + 1, F.lit(1000))), s)))
        .when(kind == "secret", F.when(core.rlike("^[0-9a-fA-F]+$"), _like(more(core), s, True)).otherwise(_like(more(core), s)))
        .when(kind.isin("given, male", "given, female", "given", "family"), _name(core, kind, s, extra))
        .otherwise(_like(more(core), s))
    )


TITLE = rf"^((?:{FEMALE}|{MALE}|Dr|Prof)\.? )"
ASSIGNED = r"""^([A-Za-z_-]+ {0,3}[=:] {0,3}["']?)(.*)$"""


def _kind(m: Column) -> Column:
    return (
        F.when(m.rlike("@"), "email").when(m.rlike(ASSIGNED), "secret").when(m.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$"), "cloud key")
        .when(m.rlike(rf"^({OCTET}\.){{3}}{OCTET}$"), "address").when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "person number").when(m.rlike(r"^\d([ -]?\d){12,18}$"), "card")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), "account").when(m.rlike(r"^[+(\d]"), "phone").otherwise("name")
    )


def _named(m: Column) -> Column:
    """The parts of a titled name."""
    title = F.regexp_extract(m, TITLE, 1)
    gender = F.when(title.rlike(rf"^(?:{FEMALE})\b"), "given, female").when(title.rlike(rf"^(?:{MALE})\b"), "given, male").otherwise("given")
    words = F.split(F.substring(m, F.length(title) + 1, F.lit(1000)), " ")
    two = F.array(_part(None, title), _part(gender, words[0]), _part(None, F.lit(" ")), _part(F.lit("family"), words[1]))
    return F.when(F.size(words) > 1, two).otherwise(F.array(_part(None, title), _part(F.lit("family"), words[0])))


def _part(kind, core: Column) -> Column:
    return F.struct((F.lit(None) if kind is None else kind).cast("string").alias("kind"), core.alias("core"))


def people(text: Column) -> Column:
    """``kind, core`` of the names behind titles, one for each word: a family name if it is one anywhere in the text,
    else a given name, with a gender if some title tells it."""
    every = F.filter(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"({NAME})"), F.lit(1)), _named)), lambda p: p["kind"].isNotNull())
    ranked = F.array_sort(F.transform(every, lambda p: F.struct(p["core"].alias("core"), F.when(p["kind"] == "family", 0).when(p["kind"] == "given", 2).otherwise(1).alias("rank"), p["kind"].alias("kind"))))
    first = F.filter(ranked, lambda p, i: (i == 0) | (F.get(ranked, i - 1)["core"] != p["core"]))
    return F.transform(first, lambda p: F.struct(p["kind"].alias("kind"), p["core"].alias("core")))


def pattern(known: Column) -> Column:
    """ANY, and as whole words the names in ``known``."""
    words = F.array_join(F.transform(known, lambda p: p["core"]), r"\E|\Q")
    return F.when(F.size(known) > 0, F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:\Q"), words, F.lit(r"\E)(?![\p{L}\p{N}])"))).otherwise(ANY)


def parts(m: Column, known: Column) -> Column:
    """The parts of a match: (kind, core), where a null kind marks what stays. A run of digits whose check sum doesn't
    hold is no card, and an address at a reserved name alone keeps its domain."""
    kind = _kind(m)
    of = lambda core: F.get(F.filter(known, lambda p: p["core"] == core), F.lit(0))["kind"]
    named = F.transform(F.when(m.rlike(TITLE), _named(m)).otherwise(F.array(_part(of(m), m))), lambda p: _part(F.when(p["kind"].isNotNull(), of(p["core"])), p["core"]))
    assigned = F.array(_part(None, F.regexp_extract(m, ASSIGNED, 1)), _part(kind, F.regexp_extract(m, ASSIGNED, 2)))
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    email = F.array(_part(F.lit("local"), local), _part(None, F.lit("@")), _part(F.when(domain != _kept_end(domain), "domain"), domain))
    card = F.array(_part(F.when(_luhn(_bare(m)) % 10 == 0, kind), m))
    return F.when(kind == "name", named).when(kind == "secret", assigned).when(kind == "email", email).when(kind == "card", card).otherwise(F.array(_part(kind, m)))


def found(text: Column, known: Column) -> Column:
    """The parts of all matches in a text, an array for each match."""
    return F.transform(F.regexp_extract_all(text, pattern(known), F.lit(0)), lambda m: parts(m, known))


def rebuilt(text: Column, known: Column, entities: Column, replaced) -> Column:
    """The text with each part of its entities put through ``replaced(kind, core)``."""
    swap = lambda e: F.array_join(F.transform(e, lambda p: F.when(p["kind"].isNull(), p["core"]).otherwise(replaced(p["kind"], p["core"]))), "")
    between = F.split(text, pattern(known), -1)
    return F.array_join(F.zip_with(between, F.transform(entities, swap), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def collisions(entities: DataFrame, key: str | None = None) -> DataFrame:
    """``kind, core, surrogate`` for the parts ``kind, core`` that may not have their first surrogate. Of values that
    share one, the least keeps it; a surrogate that is some part's value goes to none. It ends for any number of values,
    as the outcomes multiply by turn."""
    made = surrogate if key is None else lambda k, c, t: surrogate(k, c, t, key)
    open_, taken, out, turn = settle(entities.distinct(), "entities"), None, None, 0
    real = open_.select("kind", F.col("core").alias("_s"))
    while True:
        tried = open_.withColumn("_s", made(F.col("kind"), F.col("core"), turn))
        won = tried.groupBy("kind", "_s").agg(F.min("core").alias("core")).join(real, ["kind", "_s"], "left_anti")
        if taken is not None:
            won = won.join(taken, ["kind", "_s"], "left_anti")
        won = settle(won.select("kind", "core", "_s"), "won")
        taken = won.select("kind", "_s") if taken is None else taken.unionByName(won.select("kind", "_s"))
        if turn:
            out = won if out is None else out.unionByName(won)
        open_ = settle(open_.join(won, ["kind", "core"], "left_anti"), "open")
        if open_.isEmpty():
            return (won.limit(0) if out is None else out).withColumnRenamed("_s", "surrogate")
        turn += 1


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``docs`` has."""
    have = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n in have:
            n += "_"
        out.append(n)
    return out


def replace_private(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """``docs`` with surrogates in its column ``text`` and ``n_entities``, how many were replaced. ``key``: by default
    the session's (KEY); surrogates agree between runs with one key alone.

    Every row is kept with all its columns, repeated and null ones too, whatever their names (a column n_entities is
    replaced). A null text stays null and an empty one empty. An empty table gives an empty result."""
    key = key or session_key(docs.sparkSession)
    known, ents, row, mine = _free(docs, "_known", "_parts", "_row", "_mine")
    t = F.col(text)
    none = F.array().cast("array<struct<kind:string,core:string>>")
    marked = docs.drop("n_entities").withColumn(known, F.when(t.rlike(TITLED), people(t)).otherwise(none))
    marked = marked.withColumn(ents, F.when(t.rlike(HINT), found(t, F.col(known))))
    true = lambda e: F.exists(e, lambda p: p["kind"].isNotNull())
    some = F.coalesce(F.exists(ents, true), F.lit(False))
    kept = [c for c in docs.columns if c.lower() != "n_entities"]
    # Rows with entities are written to the shared folder with a number each; the others pass by.
    held = settle(marked.filter(some).withColumn(row, F.monotonically_increasing_id()), "entities")
    each = held.select(row, F.explode(F.flatten(ents)).alias("_p")).filter("_p.kind is not null").select(row, "_p.kind", "_p.core")
    others = settle(collisions(each.select("kind", "core"), key), "collisions")
    first = lambda k, c: surrogate(k, c, 0, key)
    if not others.isEmpty():
        own = each.distinct().join(others, ["kind", "core"])
        own = own.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0000", "kind", "core"), "surrogate"))).alias(mine))
        held = held.join(own, row, "left")
        first = lambda k, c: F.coalesce(F.element_at(F.col(mine), F.concat_ws("\u0000", k, c)), surrogate(k, c, 0, key))
    count = F.size(F.filter(ents, true)).alias("n_entities")
    changed = held.withColumn(text, rebuilt(t, F.col(known), F.col(ents), first)).select(*kept, count)
    return marked.filter(~some).select(*kept, F.lit(0).alias("n_entities")).unionByName(changed)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_private(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")
