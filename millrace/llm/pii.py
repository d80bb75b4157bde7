"""PII: detected entities get keyed surrogates of their own kind. DataFrame functions only.

One pattern finds e-mail addresses, IP addresses, hexadecimal secrets, access keys (by their prefix, or
behind a label such as ``token =``), IBANs, social security numbers, phone numbers, card numbers (whose
check digit must be right) and personal names (behind a title or a phrase of introduction, or with a known first
name; in a text with such a name its words are found wherever they stand). Each entity has a
canonical form (lower case, digits alone, numbers of an address), and its surrogate is a
keyed format-preserving permutation of that form: a Feistel network whose rounds shift
characters within their own alphabet (digits, Latin, accented Latin, Cyrillic, Greek; in names
vowels and consonants by themselves, so that they can be spoken; all
other letters and digits within a run of their script and category), or, for a name of a pool,
the next one in a keyed order of the names of the same gender and script. The result is laid
back into the entity's own case and punctuation. So equal entities stay equal
across all documents, word by word in names, unequal ones stay unequal, and format, script and gender match.

No entity is its own surrogate and no two share one, by construction: between the network
and its inverse every character moves one place on, so no string comes back to itself;
words that would land on a pool's name walk on; an e-mail address without letters and digits
moves its local part's punctuation. A check over the distinct entities of all documents holds this; it sees
digests of them. Texts are read and matched once.

The key decides the surrogates; whoever has it can undo them. The query takes it from ``spark.millrace.pii.key`` and
falls back to EXAMPLE_KEY, which is public and for tests alone.

Defined cases: a null text stays null, an empty one empty; texts without entities come back
unchanged; repeated rows get equal results; an empty table gives an empty result; columns
beside text pass through, whatever their names, but a column ``entities`` is replaced.
"""

from __future__ import annotations

import hmac
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common as C

ROUNDS = 4
KEY_CONF, EXAMPLE_KEY = "spark.millrace.pii.key", "example key: set your own"

# Alphabets (lower, upper in the same order) and name pools.
ALPHABETS = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâäåæçèéêëìíîïñòóôöøùúûü",
    "ÀÁÂÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÖØÙÚÛÜ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
]
HEX = ["0123456789abcdef"]
PUNCTUATION = ["._%+-"]
POOLS = {
    "female_latin": ["Alice", "Barbara", "Carmen", "Charlotte", "Claudia", "Elena", "Emily", "Hannah", "Ingrid", "Isabel", "Julia", "Katherine", "Laura", "Margaret", "Monica", "Patricia", "Rachel", "Sabine", "Susan", "Teresa"],
    "male_latin": ["Albert", "Andrew", "Antonio", "Benjamin", "Carlos", "Charles", "Daniel", "Edward", "Friedrich", "George", "Henri", "James", "Klaus", "Matthew", "Michael", "Patrick", "Richard", "Robert", "Thomas", "William"],
    "female_cyrillic": ["Анна", "Вера", "Екатерина", "Елена", "Ирина", "Людмила", "Мария", "Надежда", "Ольга", "Татьяна"],
    "male_cyrillic": ["Александр", "Борис", "Владимир", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Сергей", "Юрий"],
    "family_latin": ["Anderson", "Bennett", "Carter", "Dawson", "Ellis", "Fischer", "Garcia", "Hoffmann", "Jensen", "Keller", "Lambert", "Moreau", "Novak", "Olsen", "Porter", "Quinn", "Romero", "Schneider", "Turner", "Walker"],
}
FEMALE_TITLES, MALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Sra", "Señora", "Lady", "Dame"], ["Mr", "Herr", "Monsieur", "Sr", "Señor", "Sir", "Lord"]
TITLES = [*FEMALE_TITLES, *MALE_TITLES, "Dr", "Prof", "Rev"]
# What stands before a name that is introduced.
INTRODUCTIONS = ["name is ", "Name: ", "name: ", "Author: ", "author: ", "Contact: ", "contact: ", "Attn: ", "Dear ", "Signed, ", "Signed: ", "Sincerely, ", "Regards, ", "regards, ", "Patient: ", "Customer: "]

_FIRST = "|".join(n for k, v in POOLS.items() if not k.startswith("family") for n in v)
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LOCAL = r"\p{L}\p{N}._%+\-"
_CAP = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}++(?:-\p{Lu}\p{Ll}++)?"
_PREFIXED = r"(?:AKIA|ASIA)[0-9A-Z]{16}|[spr]k[\-_](?:live|test)[\-_][0-9A-Za-z]{16,}+|gh[pousr]_[0-9A-Za-z]{36,}+|glpat-[0-9A-Za-z_\-]{20,}+|xox[abprs]-[0-9A-Za-z\-]{10,}+|AIza[0-9A-Za-z_\-]{35}|eyJ[0-9A-Za-z_\-]{10,}+\.[0-9A-Za-z_\-]{10,}+\.[0-9A-Za-z_\-]{5,}+"
#: What a labelled value stands behind; the short tests come first, as they fail almost everywhere.
_LABEL = r"(?<=[=:\"' \t])(?<=[=:][ \t]?[\"']?)(?<=(?i:token|secret|passw(?:or)?d|api[_\- ]?key|access[_\- ]?key)[\"']?[ \t]?[=:][ \t]?[\"']?)"
_VALUE = r"[0-9A-Za-z+/_\-]{16,}+={0,2}"
#: kind -> pattern, in the order in which they are tried. Every one starts at a boundary, so a scan is linear.
PATTERNS = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++@(?:[\p{{L}}\p{{N}}\-]{{1,63}}+\.){{1,8}}[A-Za-z]{{2,24}}(?![A-Za-z])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]{0,39}[A-Fa-f])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3})(?![0-9])",
    "key": rf"(?<![0-9A-Za-z])(?:{_PREFIXED})(?![0-9A-Za-z])|{_LABEL}{_VALUE}(?![0-9A-Za-z+/_\-])",
    "name": rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{_TITLE})\.? {_CAP}(?: {_CAP})?|(?:{_FIRST}) {_CAP}|(?<={'|'.join(map(re.escape, INTRODUCTIONS))}){_CAP} {_CAP})(?!\p{{L}})",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What tells the kind of an entity that ENTITY has matched, without what stands before it.
SHAPES = PATTERNS | {"key": rf"{_PREFIXED}|{_VALUE}"}


def letter_runs() -> tuple[list[list[tuple[int, int, int]]], list[str]]:
    """All letters and digits outside ALPHABETS: (first, size, step) runs of one script and category, listed by code point // 256; and alphabets of those without a run."""
    own = set("".join(ALPHABETS))
    groups: dict[tuple, list[int]] = defaultdict(list)
    for cp in range(0x110000):
        c = chr(cp)
        cat = unicodedata.category(c)
        if cat[0] in "LN" and c not in own:
            groups[unicodedata.name(c, "?").split()[0], cat, c.lower() == c, c.upper().lower() == c].append(cp)
    runs, rest = [], defaultdict(list)
    for key, cps in groups.items():
        k = 0
        while k < len(cps):
            step, n = cps[k + 1] - cps[k] if k + 1 < len(cps) else 0, 1
            while 0 < step <= 2 and k + n < len(cps) and cps[k + n] - cps[k + n - 1] == step:
                n += 1
            if n > 1:
                runs.append((cps[k], n, step))
            else:
                rest[key[1:]].append(cps[k])
            k += n
    alone = [k for k in rest if len(rest[k]) == 1]
    few = [cp for k in alone for cp in rest.pop(k)]
    if few:
        (rest[alone[0]] if len(few) > 1 else max(rest.values(), key=len)).extend(few)
    index: list[list[tuple[int, int, int]]] = [[] for _ in range(1 + max(lo + (n - 1) * step for lo, n, step in runs) // 256)]
    for lo, n, step in runs:
        for at in range(lo // 256, (lo + (n - 1) * step) // 256 + 1):
            index[at].append((lo, n, step))
    return index, ["".join(map(chr, cps)) for cps in rest.values()]


RUNS, REST = letter_runs()
_RUNS = "\n".join(";".join(f"{lo},{n},{step}" for lo, n, step in at) for at in RUNS)
LETTERS = ALPHABETS + REST
NAMES = [n for pool in POOLS.values() for n in pool]
#: In names Latin vowels and consonants have alphabets of their own.
SPOKEN = [v for a in LETTERS for v in (["".join(c for c in a if (c in "aeiouAEIOU") == vowel) for vowel in (True, False)] if a in ALPHABETS[1:3] else [a])]
#: Steps that pass all names of a layout. The names of pools mix vowels and consonants: a cycle has 105 words or, in other scripts, 24 or more; that all others in it are names is as unlikely as a hash collision.
WALK = 1 + max(Counter(tuple(next(a for a in SPOKEN if c in a) for c in n) for n in NAMES).values())


def kind_of(e: Column) -> Column:
    """The kind of an entity that ENTITY has matched; null for a number that only looks like a card's."""
    out = None
    for kind, p in SHAPES.items():
        if kind == "name":
            return out.otherwise(kind)
        test = e.rlike(f"^(?:{p})$")
        value = F.when(luhn(F.left(digits(e), F.length(digits(e)) - 1)) == F.right(e, F.lit(1)).cast("int"), kind) if kind == "card" else F.lit(kind)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def canonical(e: Column, kind: Column) -> Column:
    """The form that equal entities share, whatever their case and punctuation."""
    return F.when(kind == "phone", F.right(digits(e), F.lit(10))).when(kind.isin("card", "ssn"), digits(e)).when(kind == "iban", F.upper(F.replace(e, F.lit(" "), F.lit("")))).when(kind.isin("email", "secret"), F.lower(e)).otherwise(e)


def stream(key: str, kind: str, r: Column, part: Column) -> Column:
    """64 hexadecimal digits that depend on the key, the round and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), part).cast("binary"), 256)


def moved(c: Column, off: Column) -> Column:
    """A character outside LETTERS moved within its run; others than letters and digits stay."""
    cp = F.ascii(c)
    near = F.transform(F.split(F.get(F.split(F.lit(_RUNS), "\n"), F.shiftright(cp, 8)), ";"), lambda r: F.split(r, ",").cast("array<int>"))
    mine = F.filter(near, lambda r: (cp >= r[0]) & (cp < r[0] + r[1] * r[2]) & ((cp - r[0]) % r[2] == 0))
    to = F.transform(mine, lambda r: r[0] + r[2] * F.pmod((cp - r[0]) / r[2] + off, r[1]).cast("int"))
    return F.coalesce(F.decode(F.unhex(F.lpad(F.hex(F.get(to, F.lit(0))), 8, "0")), "UTF-32"), c)


def shifted(s: Column, off: Callable[[Column, int], Column], alphabets: list[str]) -> Column:
    """Each character moved within its own alphabet by ``off`` (place, digits); others stay."""

    def one(c: Column, i: Column) -> Column:
        out = F.when(c == "", c)
        for a in alphabets:
            at = F.instr(F.lit(a), c)
            out = out.when(at > 0, F.substr(F.lit(a), F.pmod(at - 1 + off(i, 2), F.lit(len(a))) + 1, F.lit(1)))
        return out.otherwise(moved(c, off(i, 4)) if alphabets in (LETTERS, SPOKEN) else c)

    return F.array_join(F.transform(F.split(s, ""), one), "")


def permuted(s: Column, key: str, kind: str, alphabets: list[str]) -> Column:
    """A keyed bijection on the strings of one length and layout that moves each: Feistel rounds over the two halves, both moved one place on, the rounds undone."""
    half = F.floor(F.length(s) / 2).cast("int")
    first = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, F.length(s)).alias("r"))
    last = 2 * ROUNDS + 1

    def step(a: Column, k: Column) -> Column:
        back, turn = k > ROUNDS + 1, k.isin(ROUNDS, ROUNDS + 1)
        x, part = F.when(back, a["r"]).otherwise(a["l"]), F.when(back, a["l"]).otherwise(a["r"])
        hexes = stream(key, kind, F.when(back, last - k).otherwise(k), part)
        digits_of = lambda h: lambda i, n: F.when(turn, 1).otherwise(F.when(back, -1).otherwise(1) * F.conv(F.substr(h, (i % (64 // n)) * n + 1, F.lit(n)), 16, 10).cast("int"))
        y = F.transform(F.array(hexes), lambda h: shifted(x, digits_of(h), alphabets))[0]
        return F.struct(F.when(back, y).otherwise(part).alias("l"), F.when(back, part).otherwise(y).alias("r"))

    return F.aggregate(F.array(*[F.lit(k) for k in range(last + 1)]), first, step, lambda a: F.concat(a["l"], a["r"]))


def luhn(body: Column) -> Column:
    """The check digit that follows ``body``."""
    turned = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    return (10 - F.aggregate(turned, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10) % 10


def pooled(key: str) -> dict[str, str]:
    """Each name of a pool and its surrogate: the next name of its pool in an order that the key decides."""
    out = {}
    for pool in POOLS.values():
        line = sorted(pool, key=lambda n: hmac.new(key.encode(), n.encode(), "sha256").digest())
        out |= dict(zip(line, line[1:] + line[:1], strict=True))
    return out


def renamed(e: Column, key: str) -> Column:
    """A title in front stays; names of a pool turn within it; other words shift within their alphabets, past all names of pools."""
    known = pooled(key)
    old, new = (F.array(*[F.lit(n) for n in x]) for x in (known, known.values()))

    def one(w: Column, i: Column) -> Column:
        walk = F.aggregate(F.array(*[F.lit(k) for k in range(WALK)]), w, lambda a, k: F.when((k == 0) | a.isin(*NAMES), permuted(a, key, "name", SPOKEN)).otherwise(a))
        return F.when((i == 0) & F.rtrim(w, F.lit(".")).isin(*TITLES), w).when(F.array_contains(old, w), F.get(new, F.array_position(old, w).cast("int") - 1)).otherwise(walk)

    return F.array_join(F.transform(F.split(e, " "), one), " ")


def surrogate(canon: Column, kind: Column, key: str) -> Column:
    """The surrogate of a canonical form, itself canonical."""
    tld = F.regexp_extract(canon, r"\.[a-z]+$", 0)
    address = F.substr(canon, F.lit(1), F.length(canon) - F.length(tld))
    local = F.substring_index(address, "@", 1)
    bare = F.concat(permuted(local, key, "email", PUNCTUATION), F.substr(address, F.length(local) + 1, F.length(address)))
    mail = F.concat(F.when(address.rlike(r"[\p{L}\p{N}]"), permuted(address, key, "email", LETTERS)).otherwise(bare), tld)
    body = F.substr(canon, F.lit(1), F.length(canon) - 1)
    card = F.transform(F.array(permuted(body, key, "card", ALPHABETS[:1])), lambda b: F.concat(b, luhn(b).cast("string")))[0]
    octet = F.transform(F.split(canon, r"\."), lambda o: o.cast("int"))
    pair = lambda i: F.get(octet, F.lit(i)) * 256 + F.get(octet, F.lit(i + 1))
    by = lambda k, part: F.conv(F.substr(stream(key, "ip", k, part.cast("string")), F.lit(1), F.lit(4)), 16, 10).cast("int")

    def step(a: Column, k: Column) -> Column:
        on = F.struct(a["r"].alias("l"), ((a["l"] + by(k, a["r"])) % 65536).alias("r"))
        turn = F.struct(((a["l"] + 1) % 65536).alias("l"), a["r"].alias("r"))
        back = F.struct(F.pmod(a["r"] - by(2 * ROUNDS - k, a["l"]), F.lit(65536)).alias("l"), a["l"].alias("r"))
        return F.when(k < ROUNDS, on).when(k == ROUNDS, turn).otherwise(back)

    ip = F.aggregate(
        F.array(*[F.lit(k) for k in range(2 * ROUNDS + 1)]), F.struct(pair(0).alias("l"), pair(2).alias("r")), step,
        lambda a: F.concat_ws(".", F.floor(a["l"] / 256), a["l"] % 256, F.floor(a["r"] / 256), a["r"] % 256),
    )
    iban = F.concat(F.substr(canon, F.lit(1), F.lit(2)), permuted(F.substr(canon, F.lit(3), F.length(canon)), key, "iban", ALPHABETS[:3]))
    prefix = F.regexp_extract(canon, r"^(?:AKIA|ASIA|[spr]k[\-_](?:live|test)[\-_]|gh[pousr]_|glpat-|xox[abprs]-|AIza|eyJ)", 0)
    access = F.concat(prefix, permuted(F.substr(canon, F.length(prefix) + 1, F.length(canon)), key, "key", ALPHABETS[:3]))
    return (
        F.when(kind == "key", access).when(kind == "email", mail).when(kind == "ip", ip).when(kind == "secret", permuted(canon, key, "secret", HEX)).when(kind == "card", card)
        .when(kind.isin("ssn", "phone"), permuted(canon, key, "number", ALPHABETS[:1])).when(kind == "iban", iban).otherwise(renamed(canon, key))
    )


def laid(e: Column, kind: Column, s: Column) -> Column:
    """A canonical surrogate in the entity's own case and punctuation."""
    skipped = F.length(digits(e)) - F.length(s)  # a country code stays
    number = F.array_join(
        F.transform(F.split(e, ""), lambda c, i: F.when(
            c.rlike("[0-9]") & (F.length(digits(F.substr(e, F.lit(1), i))) >= skipped),
            F.substr(s, F.length(digits(F.substr(e, F.lit(1), i))) - skipped + 1, F.lit(1))).otherwise(c)), "",
    )
    cased = F.array_join(F.zip_with(F.split(e, ""), F.split(s, ""), lambda c, d: F.when((c != F.lower(c)) & (F.lower(F.upper(d)) == d), F.upper(d)).otherwise(d)), "")
    spaced = F.array_join(F.transform(F.split(e, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substr(s, F.length(F.replace(F.substr(e, F.lit(1), i), F.lit(" "), F.lit(""))) + 1, F.lit(1)))), "")
    return F.when(kind.isin("phone", "card", "ssn"), number).when(kind.isin("email", "secret"), cased).when(kind == "iban", spaced).otherwise(s)


def violations(found: DataFrame) -> DataFrame:
    """kind, s of surrogates that two entities share; found: kind, h (an entity's digest), s. Combined in each task before the shuffle."""
    return found.groupBy("kind", "s").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("s is null or lo <> hi").select("kind", "s")


def drawn(e: Column, key: str) -> Column:
    """For a matched string: entity (kind, surrogate; null if it is none), out (what stands in its place), check (kind, digest, canonical surrogate)."""
    step = F.transform(F.array(e), lambda x: F.struct(x.alias("e"), kind_of(x).alias("kind")))
    step = F.transform(step, lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), canonical(x["e"], x["kind"]).alias("canon")))
    step = F.transform(step, lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), x["canon"].alias("canon"), F.when(x["kind"].isNotNull(), surrogate(x["canon"], x["kind"], key)).alias("s")))
    step = F.transform(step, lambda x: F.struct(x["kind"].alias("kind"), x["canon"].alias("canon"), x["s"].alias("s"), F.when(x["kind"].isNull(), x["e"]).otherwise(laid(x["e"], x["kind"], x["s"])).alias("out")))
    return F.transform(step, lambda x: F.struct(
        F.when(x["kind"].isNotNull(), F.struct(x["kind"].alias("kind"), x["out"].alias("surrogate"))).alias("entity"), x["out"].alias("out"),
        F.when(x["kind"].isNotNull(), F.struct(x["kind"].alias("kind"), F.md5(x["canon"].cast("binary")).alias("h"), F.when(x["s"] != x["canon"], x["s"]).alias("s"))).alias("check")))[0]


def mentions(piece: Column, pattern: Column, key: str) -> Column:
    """Text between entities with the words of the text's names renamed: parts (entity, out, check)."""
    plain = lambda p: F.struct(F.lit(None).cast(ENTITY_TYPE).alias("entity"), p.alias("out"), F.lit(None).cast(CHECK_TYPE).alias("check"))
    spoken = lambda m: F.transform(F.array(renamed(m, key)), lambda s: F.struct(
        F.struct(F.lit("name").alias("kind"), s.alias("surrogate")).alias("entity"), s.alias("out"), F.struct(F.lit("name").alias("kind"), F.md5(m.cast("binary")).alias("h"), F.when(s != m, s).alias("s")).alias("check")))[0]
    found = F.transform(F.regexp_extract_all(piece, pattern, F.lit(0)), spoken)
    return F.flatten(F.zip_with(F.split(piece, pattern, -1), found, lambda p, m: F.array(plain(p), m)))


ENTITY_TYPE, CHECK_TYPE = "struct<kind:string,surrogate:string>", "struct<kind:string,h:string,s:string>"


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with text rewritten, and entities: array of (kind, surrogate) in order. Stored; the check over all entities has passed."""
    docs = docs.drop("entities")
    names = docs.columns
    found, parts = C.fresh(docs, "_found"), C.fresh(docs, "_parts")
    matched = docs.withColumn(found, F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)))
    # words of the names that stand in the text, without titles and initials
    people = F.filter(found, lambda e: kind_of(e) == "name")
    said = F.filter(F.array_distinct(F.flatten(F.transform(people, lambda e: F.split(e, " ")))), lambda w: (F.length(w) > 2) & ~F.rtrim(w, F.lit(".")).isin(*TITLES))
    word = F.concat(F.lit("(?:"), F.array_join(said, "|"), F.lit(")"))
    pattern = F.concat(F.lit(r"(?<!\p{L})"), word, F.lit("(?: "), word, F.lit(r")*(?!\p{L})"))
    pieces = F.split("text", ENTITY, -1)
    plain = lambda p: F.array(F.struct(F.lit(None).cast(ENTITY_TYPE).alias("entity"), p.alias("out"), F.lit(None).cast(CHECK_TYPE).alias("check")))
    with_names = F.transform(F.array(F.struct(pattern.alias("pattern"), pieces.alias("pieces"))), lambda x: F.transform(x["pieces"], lambda p: mentions(p, x["pattern"], key)))[0]
    between = F.when(F.size(said) > 0, with_names).otherwise(F.transform(pieces, plain))
    line = F.flatten(F.zip_with(between, F.transform(found, lambda e: drawn(e, key)), lambda p, e: F.concat(p, F.array(e))))
    cut = matched.withColumn(parts, F.when(F.size(found) > 0, F.filter(line, lambda x: x["out"].isNotNull())))
    text = F.when(F.size(found) > 0, F.array_join(F.transform(parts, lambda x: x["out"]), "")).otherwise(F.col("text"))
    picked = lambda f: F.coalesce(F.transform(F.filter(parts, lambda x: x[f].isNotNull()), lambda x: x[f]), F.array())
    out = cut.select(*[text.alias(n) if n == "text" else F.col(n) for n in names], F.when(F.col("text").isNotNull(), picked("entity")).alias("entities"), picked("check").alias(parts))
    out = C.written(out, "pii-rewritten")
    if violations(out.select(F.explode(parts).alias("c")).select("c.*").distinct()).limit(1).count():
        raise RuntimeError("the alphabets are unfit: each character must be in one only")
    return out.drop(parts)


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_CONF, EXAMPLE_KEY)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replaced(C.table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
    return out.select("doc_id", F.coalesce(F.size("entities"), F.lit(0)).cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda x: x["kind"]))), ",").alias("kinds"), "text")
