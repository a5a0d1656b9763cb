"""What personal information can look like: candidate sites and the terms around them.

The patterns here propose; whether a site is one is decided in ``privacy`` by what the corpus tells about its terms.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache
from typing import NamedTuple

import ahocorasick
import regex
import xxhash

# Words that name a kind of number, parts of names and of addresses.
ID_LABELS = (
    "ssn", "social security", "soc. sec.", "social", "nino", "ni no", "ni number", "national insurance", "steuer-id",
    "steuernummer", "idnr", "tax identification", "tax id", "passport", "reisepass", "passeport", "pasaporte", "dni",
    "nie", "nif", "documento de identidad", "identity card", "personalausweis", "ausweisnummer", "carte d’identité",
    "carte d'identité", "sozialversicherungsnummer", "numéro de sécurité sociale",
)
TITLES = (
    "mr", "mrs", "ms", "miss", "mx", "dr", "prof", "herr", "frau", "mme", "mlle", "m", "sr", "sra", "srta", "don",
    "doña", "sir", "dame", "rev",
)
PARTICLES = "st\\.|saint|von|van|de|del|della|der|den|dem|dos|das|da|di|du|la|le|las|los|ten|ter|zu|zur|zum|af|av|bin|ibn|el|al|ó|o"
STREET_TYPES = (
    "Street|Avenue|Road|Lane|Terrace|Close|Gardens|Court|Row|Way|Drive|Place|Crescent|Square|Boulevard|Grove|Hill|Mews|"
    "Walk|Rise|Parade|Quay|Wharf|Green|Circle|Highway|Trail|Alley"
)
STREET_SHORT = "St|Ave|Rd|Ln|Terr|Gdns|Ct|Dr|Pl|Cres|Sq|Blvd"
GERMAN_ENDINGS = "straße|strasse|str\\.|weg|gasse|allee|platz|damm|ring|ufer|hof|steig|pfad|markt"
GERMAN_STARTS = "Am|Im|An der|An dem|Auf der|Auf dem|Zum|Zur|Unter den|Alte|Alter|Altes|Neue|Obere|Untere|Große|Kleine"
FRENCH_TYPES = "rue|avenue|av\\.|bd|boulevard|impasse|chemin|allée|place|quai|cours|route|passage|ruelle|sentier"
SPANISH_TYPES = (
    "C/|Calle|Cl\\.|Avda\\.|Avenida|Av\\.|Plaza|Pza\\.|Plza\\.|Paseo|Camino|Cno\\.|Ronda|Travesía|Carretera|Ctra\\.|"
    "Callejón|Glorieta|Cuesta|Rambla"
)

S = r"[ \n]"
WORD = r"\p{Lu}[\p{L}’']\p{L}*(?:[’'\-]\p{L}+)*"
NUMBER = r"\d{1,4}(?:[ ]?[a-zA-Z](?![\p{L}’'.]))?(?:[ ](?:bis|ter|quater)\b)?"
UNIT = r"(?:(?:Apartment|Apt|Flat|Unit|Suite|Ste)\b\.?[ ]?\#?\d+[A-Z]?,?[ \n])?"
TAIL = (
    rf"(?:,?{S}(?:\#\d+|(?:Apt|Flat|Suite|Unit)[ ]\w+))?(?:,{S}\d+[ºo°ª](?:[ ](?:\p{{Lu}}\b|izq\.|dcha\.))?)?"
    rf"(?:,?{S}\d{{5}})?(?:,?{S}\p{{Lu}}\p{{Ll}}+(?:,?{S}(?:[A-Z]{{1,2}}\d{{1,2}}[A-Z]?[ ]\d[A-Z]{{2}}|\d{{5}})\b|(?<=,[ \n]\p{{Lu}}\p{{Ll}}{{3,20}})))?"
)
ADDRESSES = {
    "en": rf"{UNIT}(?<![\p{{L}}\d.,/:\-]){NUMBER},?{S}(?:(?:St\.|\d{{1,3}}(?:st|nd|rd|th)|{WORD}){S}){{1,4}}?(?i:(?:{STREET_TYPES})\b|(?:{STREET_SHORT})\b\.?)",
    "de": rf"(?:\p{{Lu}}\p{{L}}*(?:-\p{{L}}+)*(?:{GERMAN_ENDINGS})|(?:\p{{Lu}}\p{{L}}+[ -])(?:(?i:straße|strasse|str\.|weg|gasse|allee|platz))|(?:{GERMAN_STARTS}){S}\p{{Lu}}\p{{L}}+){S}{NUMBER}",
    "fr": rf"{UNIT}(?<![\p{{L}}\d.,/:\-]){NUMBER},?{S}(?:(?:bis|ter),?{S})?(?i:{FRENCH_TYPES}){S}(?:(?:de|du|des|la|le|les|aux?){S}|(?:l|d)[’'])*{WORD}(?:{S}{WORD})?",
    "es": rf"(?:{SPANISH_TYPES}){S}?(?:(?:de|del|la|las|los|el){S})*{WORD}(?:{S}(?:(?:de|del|la|las|los){S})*{WORD})*,?{S}(?:n\.?º[ ]?)?{NUMBER}",
}
ADDRESS = regex.compile("|".join(f"(?P<{k}>(?<![\\p{{L}}\\p{{N}}])(?:{p})(?![\\p{{L}}\\p{{N}}]){TAIL})" for k, p in ADDRESSES.items()))
#: Literal parts one of which every address has; looked up before the patterns run.
ADDRESS_HINTS = sorted(
    {f" {w}" for part in (STREET_TYPES, STREET_SHORT) for w in part.split("|")}
    | {f"\n{w}" for part in (STREET_TYPES, STREET_SHORT) for w in part.split("|")}
    | {f" {w.upper()}" for w in STREET_TYPES.split("|")}
    | {f"{w}{gap}" for w in GERMAN_ENDINGS.replace("\\", "").split("|") for gap in " \n"}
    | {f"{w} " for w in GERMAN_STARTS.split("|")}
    | {f"{w}{gap}" for w in FRENCH_TYPES.replace("\\", "").split("|") for gap in " \n"}
    | {w.replace("\\", "") for w in SPANISH_TYPES.split("|")}
)
AT = r"(?:[ ]?@[ ]?|[ ]?[\[({<][ ]?(?i:at|ät|arroba)[ ]?[\])}>][ ]?|[ ](?i:at)[ ])"
DOT = r"(?:\.|[ ]?[\[({<][ ]?(?i:dot|punkt|punto|point)[ ]?[\])}>][ ]?|[ ](?i:dot)[ ])"
AT_SIGN = regex.compile(AT)
AT_QUICK = re.compile(r"@|[ \[({<](?:at|ät|arroba)[ \])}>]", re.IGNORECASE)
LOCAL = regex.compile(r"[\p{L}\p{N}](?:[\p{L}\p{N}._%+'’\-]*[\p{L}\p{N}_])?\Z")
DOMAIN = regex.compile(
    rf"[\p{{L}}\p{{N}}\-]+(?:(?P<dot>{DOT})[\p{{L}}\p{{N}}\-]+)*?(?:{DOT})(?P<top>\p{{L}}{{2,}})(?![\p{{L}}\p{{N}}])(?!(?:{DOT})[\p{{L}}\p{{N}}])"
)
NUMBER_QUICK = re.compile(r"\d[\d ()\-./]{5,}\d")
LETTERED_QUICK = re.compile(r"\d\d ?\d\d ?\d\d")
DIGITS = regex.compile(
    r"(?<![\p{L}\p{N}_@]|\p{N}[.,/:\-])(?:\(?\+)?\(?\d(?:\d|[ ]?[\-./][ ]?(?=[\d(])|[ ]?\((?=\d)|(?<=\d)\)[ ]?[\-./]?[ ]?(?=\d)|[ ](?=\d))*(?![\p{L}\d_])"
)
LETTERED = regex.compile(
    r"(?<![\p{L}\p{N}_/.@\-])(?:[A-Za-z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-Za-z]|[XYZxyz][ \-]?\d{7}[ \-]?[A-Za-z]"
    r"|\d{8}[ \-]?[A-Za-z]|[A-Z]{1,2}\d{6,9}|(?=[A-Z]*\d[A-Z\d]*)[CFGHJKLMNPRTVWXYZ][A-Z\d]{8})(?![\p{L}\p{N}_@]|[\-/.]\p{N})"
)
LABEL = regex.compile(
    r"(?<![\p{L}])(?:" + "|".join(regex.escape(x) for x in ID_LABELS) + r")(?:[ ]?(?:no|number|nr|n°|nº|num|card)\b?\.?|[ ]?n[°º])?[ ]?[:.#]?[ ]*$",
    regex.IGNORECASE,
)
LABEL_WORDS = {w for label in ID_LABELS for w in regex.findall(r"\p{L}+", label)} - {"security", "carte", "card"}
_FAMILY = rf"(?:(?i:{PARTICLES}){S}(?:(?i:{PARTICLES}){S})*)?{WORD}"
_LOWER = r"\p{Ll}[\p{L}’'\-]+"
_END = r"(?![\p{L}\p{N}@_]|[’'\-]\p{L})"
CAPITAL = re.compile(r"(?<![\w@.+’'\-])[^\W\d_a-zà-öø-ÿ]|(?<=[ \n(\"]\.)[A-Z]")
#: What every match of the two patterns below starts with; looked up before they run, since few capitals start a name.
GIVEN_QUICK = re.compile(rf"[^\W\d_](?:[\w’'\-]*[ \n]|\.[ \n]?)(?:[^\W\d_a-zà-öø-ÿ]|(?i:{PARTICLES})[ \n])")
FAMILY_QUICK = re.compile(rf"(?:(?i:{PARTICLES})[ \n])*[^\W\d_][\w’'\-]*,[ \n]")
UPPER_START = re.compile(rf"(?:{CAPITAL.pattern})(?=[^\W\d_a-zà-öø-ÿ])")
UPPER_RUN = re.compile(r"(?<![\w’'\-])[^\W\d_a-zà-öø-ÿ][^\Wa-zà-öø-ÿ][\w’'\-]*")
GIVEN_FIRST = regex.compile(
    rf"(?P<given>\p{{Lu}}\.|{WORD}){S}?(?P<mid>(?:(?<=[ ])\p{{Lu}}\.{S}?)?)(?<=[ \n.])(?P<family>{_FAMILY}){_END}"
)
FAMILY_FIRST = regex.compile(rf"(?P<family>{_FAMILY}),{S}(?P<given>\p{{Lu}}\.|{WORD})(?P<mid>(?:{S}\p{{Lu}}\.)?){_END}")
BEFORE_FAMILY = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:(?:{PARTICLES}){S})+\Z")
_LOWER_END = r"(?![\p{L}\p{N}@_+/]|[.’'\-][\p{L}\p{N}])"
LOWER_GIVEN_FIRST = regex.compile(
    rf"(?P<given>{_LOWER}){S}(?P<mid>(?:\p{{L}}\.{S})?)(?P<family>(?:(?:{PARTICLES}){S})*{_LOWER}){_LOWER_END}"
)
LOWER_FAMILY_FIRST = regex.compile(rf"(?P<family>{_LOWER}),{S}(?P<given>{_LOWER})(?P<mid>){_LOWER_END}")
LOWER_WORD = re.compile(r"(?<![\w@.+’'\-/])[a-zà-öø-ÿ][\w’'\-]+")
LOWER_RUN = re.compile(r"(?<![\w’'\-])[^\W\d_A-Z][\w’'\-]+")
LOWER_SHORTER = regex.compile(rf"({_LOWER})[’'\-](?=[’'\-])")
TITLE = regex.compile(r"(?<!\p{L})(\p{L}+)\.?\s*\Z")
HAS_DIGIT = re.compile(r"\d").search
DIGIT, DIGIT_RUN, UPPER, LOWER = (regex.compile(x) for x in (r"\d", r"\d+", r"\p{Lu}", r"\p{Ll}"))
TOKEN = regex.compile(r"[\p{L}\p{N}]+(?:[’'\-][\p{L}\p{N}]+)*|\n|[^\s\p{L}\p{N}]")

#: Characters that stand for one other, and those whose removal or joining moves the places of the rest.
FOLD = {
    code: folded
    for code in range(128, 0x10000)
    if len(folded := unicodedata.normalize("NFKC", chr(code))) == 1 and folded != chr(code)
}
ODD = re.compile(
    "[" + "".join(
        re.escape(chr(code))
        for code in range(128, 0x10000)
        if unicodedata.category(chr(code)) == "Cf" or 0x300 <= code <= 0x36F
    ) + "]"
)
KINDS = ("email", "phone", "id_number", "address", "name")


class Site(NamedTuple):
    """A place that may hold personal information: where it is, what it may be, and the terms that tell.

    ``chains`` are keys of terms from the most to the least special: those of the left side, the right side, the form, and
    for names the given and the family name;
    ``seeds`` are the kinds that the site has for certain, by its form or label alone.
    """

    group: str
    start: int
    end: int
    chains: list[list[int]]
    seeds: tuple[str, ...]


def term_key(term: str) -> int:
    return xxhash.xxh64_intdigest(term) - (1 << 63)


def _keys(chains: tuple[tuple[str, ...], ...]) -> list[list[int]]:
    return [[term_key(term) for term in chain] for chain in chains]


def plain(text: str) -> tuple[str, list[int] | None]:
    """The text without format characters and in plain width, and each character's place in the original.

    The places are None if nothing changed.
    """
    if text.isascii() or (unicodedata.is_normalized("NFKC", text) and not ODD.search(text)):
        return text, None
    if not ODD.search(text):
        return text.translate(FOLD), None
    out, places = [], []
    for at, character in enumerate(text):
        if ord(character) < 128:
            out.append(character)
        elif unicodedata.category(character) == "Cf":
            continue
        else:
            folded = unicodedata.normalize("NFKC", character)
            out.append(folded if len(folded) == 1 else character)
        places.append(at)
    # Letters followed by combining marks read as one letter; the mark's place is skipped.
    joined = "".join(out)
    if any(unicodedata.combining(c) for c in joined):
        kept, where = [], []
        for character, place in zip(joined, places, strict=True):
            if kept and unicodedata.combining(character):
                whole = unicodedata.normalize("NFC", kept[-1] + character)
                if len(whole) == 1:
                    kept[-1] = whole
                    continue
            kept.append(character)
            where.append(place)
        return "".join(kept), where
    return joined, places


def _shown(token: str) -> str:
    """A token as a context term: lower case, numbers by their length, and letters and digits mixed by their kind."""
    if token.isalpha():
        return token.lower()
    if token.isdigit():
        return f"9x{min(len(token), 6)}"
    return DIGIT_RUN.sub("9", token.lower())


def _around(text: str, start: int, end: int, group: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    before = [_shown(m.group()) for m in TOKEN.finditer(text, max(0, start - 48), start)]
    if start > 48 and before and text[start - 49].isalnum():
        before = before[1:]
    after = []
    for m in TOKEN.finditer(text, end, min(len(text), end + 40)):
        after.append(_shown(m.group()))
        if len(after) == 3:
            break
    before = ["^", "^", "^", *before][-3:]
    after = [*after, "$", "$", "$"][:3]
    left = tuple(f"{group}<{' '.join(before[-n:])}" for n in (3, 2, 1))
    right = tuple(f"{group}>{' '.join(after[:n])}" for n in (3, 2, 1))
    return left, right


def _form(text: str) -> str:
    return UPPER.sub("A", LOWER.sub("a", DIGIT.sub("9", text)))


def lettered_sites(text: str) -> list[Site]:
    """Numbers with letters in them."""
    matches: list = []
    for quick in LETTERED_QUICK.finditer(text):
        for match in LETTERED.finditer(text, max(0, quick.start() - 4), min(len(text), quick.end() + 16)):
            if not matches or match.start() >= matches[-1].end():
                matches.append(match)
    sites = []
    for match in matches:
        start, end = match.span()
        seeds = ("id_number",) if LABEL.search(text, max(0, start - 40), start) else ()
        form = _form(match.group())
        chains = (*_around(text, start, end, "l"), (f"l={form}:{match.group()[:1].upper()}", f"l={form}"))
        sites.append(Site("lettered", start, end, _keys(chains), seeds))
    return sites


def number_sites(text: str) -> list[Site]:
    """Numbers of digits and separators, and those with letters; a number inside one with letters is none of its own."""
    sites = lettered_sites(text)
    lettered = [(s.start, s.end) for s in sites]
    done = -1
    for quick in NUMBER_QUICK.finditer(text):
        if quick.end() <= done:
            continue
        match = None
        for at in range(max(0, quick.start() - 2), quick.start() + 1):
            if match := DIGITS.match(text, at):
                break
        if match is None:
            continue
        start, end = match.span()
        done = end
        while end > start and not text[end - 1].isdigit():
            end -= 1
        if text[start] == "(" and ")" not in text[start:end]:
            start += 1  # a bracket around the whole number
        value = text[start:end]
        digits = sum(c.isdigit() for c in value)
        if not 7 <= digits <= 16 or any(low < end and start < high for low, high in lettered):
            continue
        label = LABEL.search(text, max(0, start - 40), start)
        seeds = ("id_number",) if label else ("phone",) if value[0] == "+" and 9 <= digits <= 15 else ()
        form = _form(value)
        bare = regex.sub(r"[^9+]", "-", form)
        used = "".join(sorted(set(form) - {"9"}))
        zero = value.lstrip("(+")[0] == "0"
        forms = (f"n={form}", f"n={bare}", f"n={digits}{used}{zero}", f"n={len(bare.split('-'))}{used}", f"n={digits}{zero}")
        sites.append(Site("number", start, end, _keys((*_around(text, start, end, "n"), forms)), seeds))
    return sites


def email_sites(text: str) -> list[Site]:
    sites: list[Site] = []
    for quick in AT_QUICK.finditer(text):
        at = AT_SIGN.match(text, max(0, quick.start() - 1)) or AT_SIGN.match(text, quick.start())
        if at is None:
            continue
        worded = at.group().strip().lower() == "at"
        if worded and " dot " not in (near := text[at.end() : at.end() + 80].lower()) and "[" not in near and "(" not in near:
            continue
        domain = DOMAIN.match(text, at.end())
        if domain is None:
            continue
        if worded and not regex.search(r"(?i)[ ]dot[ ]|[\[({<]", domain.group()):
            continue
        start = at.start()
        while start and (text[start - 1].isalnum() or text[start - 1] in "._%+'’-"):
            start -= 1
        local = LOCAL.search(text, start, at.start())
        if local is None:
            continue
        start, end = local.start(), domain.end()
        style = _form(at.group().strip()) + _form((domain["dot"] or "").strip())
        chains = (*_around(text, start, end, "e"), (f"e={style}:{domain['top'].lower()}", f"e={style}"))
        sites.append(Site("email", start, end, _keys(chains), ("email",)))
    return sites


@cache
def _hints() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for hint in ADDRESS_HINTS:
        found.add_word(hint, len(hint))
    found.make_automaton()
    return found


def address_sites(text: str) -> list[Site]:
    sites = []
    windows = []
    for last, length in _hints().iter(text):
        at = last + 1 - length
        if HAS_DIGIT(text, max(0, at - 40), min(len(text), at + length + 34)):
            windows.append((max(0, at - 60), min(len(text), at + 110)))
    joined: list[list[int]] = []
    for low, high in sorted(windows):
        if joined and low <= joined[-1][1]:
            joined[-1][1] = max(high, joined[-1][1])
        else:
            joined.append([low, high])
    matches = [m for low, high in joined for m in ADDRESS.finditer(text, low, high)]
    for match in matches:
        kind = match.lastgroup
        value = match.group()
        start, end = match.span()
        while value[-1] in ", \n":
            value, end = value[:-1], end - 1
        postcode = regex.search(r"\d{5}|[A-Z]{2}\d{1,2} \d[A-Z]{2}", value) is not None
        words = [w.lower() for w in regex.findall(r"\p{L}{2,}", value)]
        placed = postcode or regex.search(r"^(?:Apt|Flat|Unit|Suite)|\d+[ºo°ª] |,[ \n]\p{Lu}\p{Ll}+$", value) is not None
        seeds = ("address",) if placed else ()
        chains = (
            *_around(text, start, end, "a"),
            (f"a={kind}:{words[0] if kind in ('fr', 'es') else words[-1]}", f"a={kind}"),
        )
        sites.append(Site("address", start, end, _keys(chains), seeds))
    return sites


def _name_site(
    text: str, start: int, end: int, given: str, family: str, order: str, middle: bool, style: str, known: dict[str, set[str]]
) -> Site | None:
    first, last = given.lower(), family.lower()
    if first.strip(".") in TITLES and (len(first.strip(".")) > 1 or not first.endswith(".")):
        return None
    initial = first.endswith(".")
    case = "m" if family.isupper() and not given.isupper() else style
    core = last.split()[-1]
    if not LABEL_WORDS.isdisjoint(core.split("-")):
        return None
    # Parts of a double name tell as much as names that stand alone; a particle belongs to its name.
    parts = [last] if " " in last else [core, *core.split("-")] if "-" in core else [core]
    left, right = _around(text, start, end, "p")
    before = TITLE.search(text, max(0, start - 8), start)
    if before and before[1].lower() in TITLES and len(before[1]) > 1:
        left = ("p<title",)
    form = f"p={order}{'i' if initial else 'g'}{'m' if middle else ''}{case}{'-' if len(parts) > 1 else ''}"
    form += "p" if " " in last else ""
    chains = (left, right, (form,), (f"p.g {first}",) if not initial else ("p.i",), tuple(f"p.f {p}" for p in parts))
    seed = not initial and style == "c" and first in known["given"] and (last in known["family"] or core in known["family"])
    return Site("name", start, end, _keys(chains), ("name",) if seed else ())


def _name_at(
    sites: list[Site], text: str, start: int, match, order: str, style: str, known: dict[str, set[str]], likely
) -> None:
    """Add the name of a match to the sites, if it is worth a look."""
    given, family = match["given"], text[start : match.end("family")] if order == "fg" else match["family"]
    if style == "c" and given.isupper() and not given.endswith(".") and family.isupper():
        style = "u"
    core = family.lower().split()[-1]
    if style == "l" and not (likely("g", given.lower()) and likely("f", core)):
        return
    if style == "u" and given.lower() not in known["given"] and core not in known["family"]:
        # Where all is in capitals case tells nothing, and there are many such pairs of words.
        if likely is None or not (likely("g", given.lower()) and likely("f", core)):
            return
    if site := _name_site(text, start, match.end(), given, family, order, bool(match["mid"]), style, known):
        sites.append(site)


def capital_name_sites(text: str, known: dict[str, set[str]], is_name_part=None, starts=CAPITAL) -> list[Site]:
    """Sites of personal names that start with a capital; in text all in capitals, names with a part on the staff list, or
    with parts that ``is_name_part(kind, word)`` knows from other text."""
    sites: list[Site] = []
    for capital in starts.finditer(text):
        at = capital.start()
        if GIVEN_QUICK.match(text, at) and (match := GIVEN_FIRST.match(text, at)):
            _name_at(sites, text, at, match, "gf", "c", known, is_name_part)
        if FAMILY_QUICK.match(text, at) and (match := FAMILY_FIRST.match(text, at)):
            _name_at(sites, text, at, match, "fg", "c", known, is_name_part)
            if particle := BEFORE_FAMILY.search(text, max(0, at - 16), at):
                _name_at(sites, text, particle.start(), match, "fg", "c", known, is_name_part)
    return sites


def upper_name_sites(text: str, known: dict[str, set[str]], is_name_part) -> list[Site]:
    """Those in text all in capitals that ``capital_name_sites`` finds by ``is_name_part`` only."""
    if not UPPER_START.search(text):
        return []
    first = {(s.start, s.end) for s in capital_name_sites(text, known, None, UPPER_START)}
    return [s for s in capital_name_sites(text, known, is_name_part, UPPER_START) if (s.start, s.end) not in first]


def lower_name_sites(text: str, known: dict[str, set[str]], is_name_part=None) -> list[Site]:
    """Sites of personal names in lower case; ``is_name_part(kind, word)`` says which words are worth a look."""
    likely = is_name_part or (lambda kind, word: word in known["given" if kind == "g" else "family"])
    sites: list[Site] = []
    words = set(LOWER_WORD.findall(text))
    if is_name_part:
        hits = {w for w in words if is_name_part("g", w) or is_name_part("f", w)}
    else:
        hits = {w for part in ("given", "family") for w in words & known[part]}
    for hit in hits:
        start = text.find(hit)
        while start >= 0:
            word = LOWER_WORD.match(text, start)
            if word and word.end() == start + len(hit):
                if match := LOWER_GIVEN_FIRST.match(text, start):
                    _name_at(sites, text, start, match, "gf", "l", known, likely)
                if match := LOWER_FAMILY_FIRST.match(text, start):
                    _name_at(sites, text, start, match, "fg", "l", known, likely)
                    if particle := BEFORE_FAMILY.search(text, max(0, start - 16), start):
                        _name_at(sites, text, particle.start(), match, "fg", "l", known, likely)
            start = text.find(hit, start + len(hit))
    return sorted(sites, key=lambda s: s.start)


def lower_words(text: str) -> set[str]:
    """Every word that ``lower_name_sites`` or ``upper_name_sites`` may ask for and that can be a part of a name, in lower case.

    Where a sign follows a word, the patterns give up marks at its end.
    """
    words = {*LOWER_RUN.findall(text), *UPPER_RUN.findall(text)}  # more than are asked for: a run can have digits
    for word in [w for w in words if not w.isalpha()]:
        words.add(word[:-1])
        if shorter := LOWER_SHORTER.match(word):
            words.add(shorter[1])
    return {w.lower() for w in words}
