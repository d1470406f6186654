"""Personal data replaced by surrogates of the same type, gender, script and format.

A mention is reduced to its entity (kind, canonical value). A keyed hash of the
entity yields the surrogate, poured into the form of each mention, so all mentions
of an entity, in whichever form and document, get the same surrogate. Collision
checks run over the distinct entities of the whole corpus: a surrogate that
another entity has, or that is itself an entity of the corpus, is drawn again.
The few entities that needed that travel to their documents in a join; all others
need nothing but the key.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctionlens.llm.common import written

#: Setting that holds the key of the registered queries and the pipeline.
KEY_SETTING = "spark.auctionlens.surrogates.key"
#: The key where that is unset, as on test data. It is public, so it hides nothing: a surrogate could be guessed back.
PUBLIC_KEY = "surrogates-1"
#: Rounds of collision checks; from WIDEN on each round adds a character, so a full format cannot block the end.
WIDEN = 8

#: Given names by (script, gender), in alphabetical order.
GIVEN = {
    ("latin", "f"): "Alice Anna Anne Barbara Carmen Claire Elena Elizabeth Emily Emma Greta Helga Ingrid Isabel Jane "
    "Jennifer Jessica Julia Karen Karin Laura Linda Lisa Lucia Maria Marta Mary Michelle Monika Nancy Nicole Olivia "
    "Patricia Sabine Sandra Sarah Sofia Susan Teresa Ursula Yvonne".split(),
    ("latin", "m"): "Andreas Andrew Anthony Antonio Bruno Carlos Charles Christopher Daniel David Diego Edward Felix Georg "
    "George Hans Henri Hugo James Javier John Jose Joseph Juan Karl Kevin Klaus Luis Manuel Mark Matthew Michael Miguel "
    "Pablo Paul Peter Richard Robert Steven Thomas William".split(),
    ("greek", "f"): "Άννα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
    ("cyrillic", "f"): "Анна Елена Ирина Мария Наталья Ольга".split(),
    ("cyrillic", "m"): "Алексей Андрей Владимир Дмитрий Иван Сергей".split(),
}
#: Syllables of invented surnames.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ka ke la le li lo ma me mi mo na ne no pa ra re ri ro sa se ta te to va ve".split(),
    "greek": "βα γα δα κα κο λα λε μα μι να νο πα ρα ρο σα τα τε".split(),
    "cyrillic": "ба ва го да де ка ко ла ле ма ми на но ра ро са та".split(),
}
_OF_NAME = {name: key for key, names in GIVEN.items() for name in names}
#: Titles before a name, by the gender they tell.
TITLES = {
    "f": "Frau Madame Miss Mme Mrs Ms Señora Signora Sra".split(),
    "m": "Herr Herrn Mister Monsieur Mr Señor Signor Sr".split(),
    "": "Dr Prof Professor".split(),
}
_GENDER_OF = {title: gender for gender, titles in TITLES.items() for title in titles}

#: Fixed patterns of the kinds that begin with a digit, a sign or a word of their own.
_DIGITS = re.compile(
    r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w.]*\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,5}|\(\d{3}\) ?\d{3}[ .-]\d{4}"
    r"|\d{3}[.-]\d{3}[.-]\d{4}|(?<![.,-])0\d(?:[ .]\d{2}){4}|(?<![.,-])0\d{2,4}[ -]\d{3,8}(?:[ -]\d{3,4}){0,2})(?!\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<!\w)\d(?:[ -]?\d){12,18}(?!\w))"
)
_ADDRESS = re.compile(r"(?:\d{1,3}\.){3}\d{1,3}(?![\w.]*\d)")
#: Digits of a phone number, its country's included, by country; others have 8 to 15.
_LENGTHS = {
    "1": (11, 11), "7": (11, 11), "30": (12, 12), "31": (11, 11), "32": (10, 11), "33": (11, 11), "34": (11, 11),
    "39": (9, 13), "41": (11, 11), "43": (9, 15), "44": (11, 12), "45": (10, 10), "47": (10, 10), "48": (11, 11),
    "49": (9, 13), "351": (12, 12), "380": (12, 12), "420": (12, 12), "421": (12, 12),
}
#: How the digits of a card are grouped, where they are.
_GROUPED = frozenset([(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)])
_SECRET = re.compile(
    r"(?P<lead>(?:(?<![A-Za-z0-9])(?:password|passphrase|passwd|pass|pwd|token|secret|api[_-]?key|access[_-]?key)\b"
    r"[\"']?\s*[=:]\s*[\"']?|\bbearer +))(?P<secret>[A-Za-z0-9_\-/+.]{6,}(?<!\.))"
    r"|(?P<cloud>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}\b|\bsk-[A-Za-z0-9_-]{16,}"
    r"|\bxox[abprs]-[A-Za-z0-9-]{10,}|\bAIza[A-Za-z0-9_-]{30,}|\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})",
    re.IGNORECASE,
)
#: What any secret's surroundings hold, in lower case; a plain search for these is much faster than the pattern.
_SECRET_WORDS = (
    "pass", "pwd", "token", "secret", "key", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "bearer", "sk-", "xox",
    "aiza", "eyj",
)
_KEY_BLOCK = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----(.*?)(?:-----END \1-----|\Z)", re.DOTALL)
#: Where digits may stand together; patterns that begin with a set of characters are searched fastest.
_RUN = re.compile(r"[\d+(][\d ().+\-]{5,}")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_LOCAL = re.compile(r"[A-Za-z0-9._%+\-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
_IP6 = re.compile(r"[0-9A-Fa-f:]*(?:\.\d+){0,3}")
_UPPER = "A-ZÀ-ÖØ-ÞΆ-ΫА-ЯЁ"
#: A part of a name: capitalised, with a short prefix or a hyphen perhaps.
_PART = rf"(?:[{_UPPER}]['’])?[{_UPPER}][\w]+(?:-[{_UPPER}]\w+)*"
_FULL_NAME = re.compile(rf"({_PART})(?= ({_PART}))")
_TITLED = re.compile(rf"\b({'|'.join(_GENDER_OF)})\b\.?(?: (?:Dr|Prof)\b\.?)? ({_PART})(?: ({_PART}))?")
#: Two capitalised words, or a title and one; the patterns above are tried only where this one finds them.
_PAIR = re.compile(rf"[{_UPPER}][\w'’-]+\.?(?= [{_UPPER}])")
#: A field, a greeting or the end of a letter, which a full name follows; what any of them holds, for a plain search.
_CUED = re.compile(
    rf"\b(?:(?:[Ff]ull )?[Nn]ame|[Cc]ontact|[Ff]rom|[Ss]igned(?: by)?|[Aa]uthor|[Cc]ustomer|[Pp]atient): *({_PART}) ({_PART})"
    rf"|\bDear ({_PART}) ({_PART})(?=[,:\n])|\b(?:[Rr]egards|[Ss]incerely|[Gg]rüßen?|[Ss]aludos|[Cc]ordialement),?\n+({_PART}) ({_PART})"
)
_CUES = ("ame: ", "ontact: ", "rom: ", "igned: ", "igned by: ", "uthor: ", "ustomer: ", "atient: ", "Dear ", "egards", "incerely",
         "rüße", "aludos", "ordialement")
_BEFORE_ADDRESS = re.compile(rf"({_PART}) ({_PART}) ?[<(][\w.%+-]*\Z")
_RUSSIAN = re.compile(r"[А-ЯЁ]\w*(?:[оеё]в|ин)(?:а|у|ым|ой|ых)?|[А-ЯЁ]\w*ск(?:ий|ая|ого|ой|ому|им)")

Mention = tuple[int, int, str, str]  # start, end, kind, canonical value


def luhn(digits: str) -> bool:
    odd = [int(c) for c in digits[::-1]]
    return (sum(odd[::2]) + sum(d * 2 - 9 * (d > 4) for d in odd[1::2])) % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _begins_word(text: str, at: int) -> bool:
    return at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_")


def _end_of(text: str, m: re.Match) -> int | None:
    """Where the number ends: its groups may be followed by those of another one. None if it is no number of its kind."""
    kind = m.lastgroup
    if kind == "phone" and m[0][0] == "0":  # national: an area code and a subscriber's number
        return m.end() if 9 <= sum(c.isdigit() for c in m[0]) <= 14 else None
    if kind not in ("phone", "card") or kind == "phone" and m[0][0] != "+":
        return m.end()
    groups = [(g.start(), g.end()) for g in re.compile(r"\d+").finditer(text, m.start(), m.end())]
    address = next((a for a, _ in groups[1:] if text[a - 1] == " " and _ADDRESS.match(text, a)), m.end())
    ends, sizes, total = [], [], 0
    for a, b in groups:
        if a >= address:
            break
        total += b - a
        sizes.append(b - a)
        ends.append((b, total, tuple(sizes)))
    if kind == "card":
        # One group, or the usual ones, before all others; then the longest.
        ends = [e for e in ends if e[1] >= 13 and luhn(re.sub(r"\D", "", text[m.start() : e[0]]))]
        return max(ends, key=lambda e: (len(e[2]) == 1 or e[2] in _GROUPED, e[1]))[0] if ends else None
    digits = re.sub(r"\D", "", m[0])
    least, most = next((_LENGTHS[digits[:n]] for n in (3, 2, 1) if digits[:n] in _LENGTHS), (8, 15))
    for low, high in ((least, most), (8, 15)):
        good = [b for b, n, _ in ends if low <= n <= high]
        if good:
            return good[-1]
    return m.end()


def mentions(text: str) -> list[Mention]:
    """All mentions of a text, in order and without overlaps."""
    found: list[Mention] = []
    at = text.find("@")
    while at >= 0:
        local, domain = _LOCAL.search(text[max(0, at - 64) : at]), _DOMAIN.match(text, at + 1)
        if local and domain:
            found.append((at - len(local[0]), domain.end(), "email", (local[0] + "@" + domain[0]).lower()))
        at = text.find("@", at + 1)
    for run in _RUN.finditer(text):
        m = _DIGITS.search(text, run.start(), run.end() + 2)
        while m:
            kind, end = m.lastgroup, _end_of(text, m)
            if end:
                part = text[m.start() : end]
                found.append((m.start(), end, kind, part if kind == "ip" else re.sub(r"\D", "", part)))
            m = _DIGITS.search(text, end or m.start() + 1, run.end() + 2)
    found += _addresses6(text)
    lower = text.lower()
    if any(w in lower for w in _SECRET_WORDS):
        for m in _SECRET.finditer(text):
            kind = "secret" if m["secret"] else "cloud"
            if kind == "cloud" or re.search(r"\d", m["secret"]):
                found.append((m.start(kind), m.end(kind), "secret", m[kind]))
        if "private key" in lower:
            found += [(m.start(2), m.end(2), "secret", m[2]) for m in _KEY_BLOCK.finditer(text) if m[2].strip()]
    for m in _IBAN.finditer(text):
        value = m[0].replace(" ", "")
        if _begins_word(text, m.start()) and 15 <= len(value) <= 34 and _mod97(value) == 1:
            found.append((m.start(), m.end(), "iban", value))
    found += _names(text)
    found.sort(key=lambda x: (x[0], -x[1]))
    kept: list[Mention] = []
    for x in found:
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    return kept


def _addresses6(text: str) -> list[Mention]:
    """IPv6 addresses of three groups or more; their canonical value is the shortest form."""
    found, done = [], 0
    at = text.find(":")
    while at >= 0:
        if at >= done:
            start = at - len(re.search(r"[0-9A-Fa-f]*\Z", text[max(0, at - 5) : at])[0])
            m = _IP6.match(text, start)
            done, value = max(m.end(), at + 1), m[0].rstrip(":.") if not m[0].endswith("::") else m[0]
            if value.count(":") >= 2 and _begins_word(text, start) and len(re.findall(r"[0-9A-Fa-f]+", value)) >= 3:
                end = start + len(value)
                try:
                    address = ipaddress.IPv6Address(value)
                except ValueError:
                    address = None
                if address and not (end < len(text) and (text[end].isalnum() or text[end] == "_")):
                    found.append((start, end, "ipv6", address.compressed))
        at = text.find(":", max(at + 1, done))
    return found


def _plain(name: str) -> str:
    """The name with a capital and small letters after each mark, and without accents if it is Latin."""
    name = "".join(c for c in unicodedata.normalize("NFD", name) if not "\u0300" <= c <= "\u036f") if name < "Ͱ" else name
    return name.title() if name.isupper() else name


def _known(given: str) -> tuple[str, str] | None:
    """(script, gender) of a given name, by its first part; None if it is not listed."""
    return _OF_NAME.get(_plain(given)) or _OF_NAME.get(_plain(given).split("-")[0])


def _name(given: str, surname: str, gender: str = "") -> str:
    """The canonical value: both names, with the gender that a title told before them if the given name is not listed."""
    shown = lambda x: x.title() if x.isupper() else x
    told = "" if _known(given) else gender
    return f"{told}|{shown(given)} {shown(surname)}" if told else f"{shown(given)} {shown(surname)}"


def _names(text: str) -> list[Mention]:
    """Names of persons, and later mentions of their parts in the same text.

    Full names with a listed given name, or with a Russian surname; names after a title; full names in a field, after
    a greeting, in a signature or before an address in brackets. A title and a surname alone mean the person of that
    surname whom the text names in full, if there is one.
    """
    full: dict[int, tuple[int, str, str, str]] = {}  # end, given, surname, gender by start
    short: list[tuple[int, int, str, str]] = []
    for hit in _PAIR.finditer(text):
        if not _begins_word(text, hit.start()):
            continue
        title = hit[0].rstrip(".")
        if title in _GENDER_OF:
            m = _TITLED.match(text, hit.start())
            if m and m[3] and m[2] not in _GENDER_OF:
                full.setdefault(m.start(2), (m.end(3), m[2], m[3], _GENDER_OF[title]))
            elif m and m[2] not in _GENDER_OF:
                short.append((m.start(2), m.end(2), m[2], _GENDER_OF[title]))
        elif m := _FULL_NAME.match(text, hit.start()):
            listed = _known(m[1]) and not _known(m[2]) and len(m[2]) > 2 and m[1].isupper() == m[2].isupper()
            if listed or m[2][0] >= "А" and _RUSSIAN.fullmatch(m[2]) and m[1][0] >= "А":
                full.setdefault(m.start(), (m.end(2), m[1], m[2], ""))
    cued = list(_CUED.finditer(text)) if any(c in text for c in _CUES) else []
    at = text.find("@")
    while at >= 0:
        first = max(0, at - 160)
        if m := _BEFORE_ADDRESS.search(text[first:at]):
            full.setdefault(first + m.start(1), (first + m.end(2), m[1], m[2], ""))
        at = text.find("@", at + 1)
    for m in cued:
        i = m.lastindex
        if m[i - 1] not in _GENDER_OF:
            full.setdefault(m.start(i - 1), (m.end(i), m[i - 1], m[i], ""))
    genders: dict[tuple[str, str], str] = {}
    for _, given, surname, gender in full.values():
        genders[given, surname] = genders.get((given, surname)) or gender
    found, parts = [], {}
    for start, (end, given, surname, _) in sorted(full.items()):
        value = _name(given, surname, genders[given, surname])
        found.append((start, end, "name", value))
        parts.setdefault(given, ("given", value))
        parts.setdefault(surname, ("surname", value))
    for _, _, surname, gender in short:
        parts.setdefault(surname, ("surname", _name("-", surname, gender)))
    if parts:
        taken, i = sorted((a, b) for a, b, *_ in found), 0
        for m in re.finditer(r"\b(?:%s)\b" % "|".join(map(re.escape, sorted(parts, key=len, reverse=True))), text):
            while i < len(taken) and taken[i][1] <= m.start():
                i += 1
            if i == len(taken) or m.start() < taken[i][0]:
                found.append((m.start(), m.end(), *parts[m[0]]))
    return found


class _Stream:
    """Keyed numbers that depend on an entity and the draw alone."""

    def __init__(self, key: str, kind: str, value: str, draw: int):
        self.seed, self.count, self.pool = f"{kind}|{draw}|{value}".encode(), 0, b""
        self.key = key.encode()

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.seed + b"|%d" % self.count, hashlib.sha256).digest()
            self.count += 1
        head, self.pool = self.pool[:4], self.pool[4:]
        return int.from_bytes(head, "big") % n

    def like(self, text: str) -> str:
        """Each digit by a digit, each letter by a letter of its case; hexadecimal stays hexadecimal."""
        low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
            low, up = low[:6], up[:6]
        pick = lambda c: (
            str(self.below(10)) if c.isdigit() else low[self.below(len(low))] if c.islower()
            else up[self.below(len(up))] if c.isupper() else c
        )
        return "".join(map(pick, text))


def _script(name: str) -> str:
    return "cyrillic" if "Ѐ" <= name[0] <= "ӿ" else "greek" if "Ͱ" <= name[0] <= "Ͽ" else "latin"


def surrogate(kind: str, value: str, draw: int = 0, key: str = PUBLIC_KEY) -> str:
    """The canonical value that takes the entity's place in its ``draw``-th attempt.

    From WIDEN draws on a character more makes room, but for addresses of hosts and IBANs, whose length is fixed.
    """
    s = _Stream(key, kind, value, draw)
    more = "".join(str(s.below(10)) for _ in range(max(0, draw - WIDEN + 1)))
    if kind == "name":
        told, _, whole = value.rpartition("|")
        given, surname = whole.split(" ", 1)
        script, gender = _known(given) or (_script(surname), told)
        names = GIVEN[script, gender] if gender else GIVEN[script, "f"] + GIVEN[script, "m"]
        parts = SYLLABLES[script]
        new = "".join(parts[s.below(len(parts))] for _ in range(max(2, len(surname) // 2) + max(0, draw - WIDEN + 1)))
        return f"{names[s.below(len(names))]} {new.capitalize()}"
    if kind == "email":
        local, domain = value.split("@")
        host, top = domain.rsplit(".", 1)
        return f"{s.like(local)}{more}@{s.like(host)}.{top}"
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "ipv6":  # each group by one of its length
        return re.sub(
            r"[0-9a-f]+", lambda g: "".join("123456789abcdef"[s.below(15)] for _ in g[0]), value.lower()
        )
    if kind == "phone":  # the country's digits stay, or the zero in front
        keep = 1 if value[0] == "0" else max(0, min(3, len(value) - 10))
        return value[:keep] + s.like(value[keep:]) + more
    if kind == "card":
        body = value[0] + s.like(value[1:-1]) + more
        return next(body + d for d in "0123456789" if luhn(body + d))
    if kind == "iban":
        body = s.like(value[4:])
        return f"{value[:2]}{98 - _mod97(value[:2] + '00' + body):02d}{body}"
    if kind == "secret":
        head = re.match(r"AKIA|ASIA|gh[pousr]_|", value)[0]
        return head + s.like(value[len(head) :]) + more
    return s.like(value) + more


def poured(mention: str, kind: str, new: str) -> str:
    """A canonical surrogate in the form of the mention: its separators, or its upper case."""
    if kind in ("phone", "card", "ssn", "iban"):
        rest = iter(new)
        out = "".join(next(rest, "") if c.isalnum() else c for c in mention)
        return out + "".join(rest)
    if kind == "email" and mention != mention.lower():
        if len(new) == len(mention):
            return "".join(n.upper() if c.isupper() else n for c, n in zip(mention, new))
    if kind in ("name", "given", "surname", "ipv6") and mention.isupper():
        return new.upper()
    return new


def replaced(text: str, draws: dict[tuple[str, str], int], key: str = PUBLIC_KEY) -> tuple[str, dict[str, int]]:
    """The text with surrogates, and how many mentions of each kind it had."""
    out, end, counts = [], 0, {}
    for start, stop, kind, value in mentions(text):
        of = "name" if kind in ("given", "surname") else kind
        new = surrogate(of, value, draws.get((of, value), 0), key)
        if kind != of:
            new = new.split(" ", 1)[kind == "surname"]
        out += [text[end:start], poured(text[start:stop], kind, new)]
        end = stop
        counts[of] = counts.get(of, 0) + 1
    return "".join([*out, text[end:]]) if out else text, counts


def entities(docs: DataFrame) -> DataFrame:
    """(place, kind, value) of every entity of every text; ``place`` is the text's hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, kinds, values = [], [], []
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, value in {("name" if m[2] in ("given", "surname") else m[2], m[3]) for m in mentions(text)}:
                    place.append(at)
                    kinds.append(kind)
                    values.append(value)
            arrays = [pa.array(place, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["place", "kind", "value"])

    texts = docs.select(F.xxhash64("text").alias("place"), "text").where("text is not null")
    return texts.mapInArrow(rows, "place bigint, kind string, value string")


def draw_again(found: DataFrame, key: str = PUBLIC_KEY, rename=surrogate) -> DataFrame:
    """(kind, value, draw) of the distinct entities whose first surrogate collides, with the first draw that doesn't.

    A surrogate that is an entity of the corpus, or that an entity of fewer draws has, is drawn again; of entities that
    share one in the same round the smallest value keeps it. The first round sets all surrogates side by side; each
    further one shuffles the losers alone and looks up what they hit.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [rename(k, v, d, key) for k, v, d in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=[*names, "new"])

    names = ["kind", "value", "draw"]
    real = written(found.select("kind", "value").distinct(), "entities")
    asked, kept = real.withColumn("draw", F.lit(0)), None
    while True:
        drawn = written(asked.select(names).mapInArrow(name, "kind string, value string, draw int, new string"), "surrogates")
        owner = drawn.groupBy("kind", "new").agg(F.min("value").alias("owner"))
        used = real.select("kind", F.col("value").alias("new"))
        used = used if kept is None else used.unionByName(kept.select("kind", "new"))
        # A semi join, so that the few losers are what is sent around, not the entities that they are held against.
        hit = used.join(owner.select("kind", "new"), ["kind", "new"], "left_semi").distinct().withColumn("hit", F.lit(True))
        checked = drawn.join(owner, ["kind", "new"]).join(hit, ["kind", "new"], "left")
        lost = F.col("hit").isNotNull() | (F.col("owner") != F.col("value"))
        state = written(checked.select(*names, "new", lost.alias("lost")), "draws")
        kept = state.where("not lost") if kept is None else kept.unionByName(state.where("not lost"))
        losers = state.where("lost")
        if losers.isEmpty():
            return kept.where("draw > 0").select(names)
        asked = losers.withColumn("draw", F.col("draw") + 1)


def session_key(spark: SparkSession) -> str:
    """The key that the session is set to use, or the public one."""
    return spark.conf.get(KEY_SETTING, None) or PUBLIC_KEY


def replace_personal_data(docs: DataFrame, key: str | None = None, counts: bool = False) -> DataFrame:
    """The documents with surrogates in ``text``; with ``counts`` also ``pii``, a map from kind to mentions.

    ``key`` is the caller's secret; the session's if none is given.

    Null and empty texts stay as they are; repeated rows and null ids are rows like
    others; all other columns are passed on, but for one named ``pii`` if it is added.
    """
    key = key or session_key(docs.sparkSession)
    found = entities(docs)
    again = written(draw_again(found, key), "again")
    # Only the texts that hold such an entity: a short list, which Spark broadcasts if its written size allows.
    per_text = (
        found.join(again, ["kind", "value"]).groupBy("place")
        .agg(F.collect_set(F.struct("kind", "value", "draw")).alias("__draws"))
    )
    lists = written(per_text, "draws").withColumnRenamed("place", "__place")
    docs = docs.drop("pii") if counts else docs
    joined = docs.withColumn("__at", F.xxhash64("text")).join(lists, F.col("__at") == F.col("__place"), "left")
    joined = joined.select(*docs.columns, "__draws")
    columns, at = docs.columns, docs.columns.index("text")
    added = [T.StructField("pii", T.MapType(T.StringType(), T.IntegerType()))] if counts else []
    schema = T.StructType([*docs.schema.fields, *added])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds = [], []
            for text, draws in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()):
                known = {(d["kind"], d["value"]): d["draw"] for d in draws or ()}
                new, found = (None, {}) if text is None else replaced(text, known, key)
                texts.append(new)
                kinds.append(list(found.items()))
            arrays = [batch.column(i) for i in range(len(columns))]
            arrays[at] = pa.array(texts, pa.string())
            if counts:
                arrays.append(pa.array(kinds, pa.map_(pa.string(), pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return joined.mapInArrow(rows, schema)


def query(docs: DataFrame) -> DataFrame:
    return replace_personal_data(docs.select("doc_id", "text"), counts=True)
