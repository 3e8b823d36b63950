"""Part descriptions to articles, materials, finishes and sizes.

The vocabulary below is that of the part descriptions; typing slips of its words (a letter dropped, doubled or two
neighbours swapped) are derived by rule.
"""

from __future__ import annotations

import itertools
import re
import unicodedata

# fixed values: words and abbreviations with the word they stand for
WORDS = {
    "wheel": "whl", "nozzle": "nzl", "rivet": "rvt", "chain": "chn", "clevis": "clvs", "hose": "", "fitting": "ftg", "shim": "", "ring": "rg",
    "clamp": "clmp", "lip": "", "seal": "sl", "inductor": "ind", "coil": "", "ball": "", "bearing": "brg", "gasket": "gskt", "flat": "flt",
    "guide": "gde", "rail": "", "cable": "cbl", "gland": "", "roller": "rlr", "base": "bs", "frame": "", "retaining": "", "dowel": "dwl",
    "pin": "", "stud": "", "bolt": "blt", "terminal": "term", "strip": "", "drive": "drv", "shaft": "", "elbow": "elb", "pipe": "",
    "linear": "lin", "pressure": "press", "plate": "", "mounting": "mtg", "brace": "", "adapter": "adpt", "sleeve": "", "manifold": "mnfld",
    "block": "", "circlip": "circlp", "check": "chk", "valve": "vlv", "heatsink": "", "heat": "", "sink": "", "locknut": "lknut", "lock": "",
    "nut": "", "hex": "", "screw": "scr scrw", "spur": "", "worm": "", "end": "", "cap": "", "link": "", "stator": "", "core": "", "rotor": "",
    "hub": "", "oring": "", "split": "", "stainless": "ss sst inox", "aluminium": "al alu alum aluminum", "cast": "", "iron": "", "carbon": "",
    "steel": "", "epdm": "", "rubber": "", "ptfe": "", "silicone": "sil vmq", "acetal": "pom", "titanium": "ti titan", "copper": "cu copr",
    "bronze": "brz", "polyamide": "pa", "plain": "pln untreated", "zinc": "zn", "nickel": "ni", "plated": "pl", "passivated": "passiv",
    "phosphated": "phos", "powder": "pwdr", "coated": "ctd", "black": "blk", "oxide": "ox", "polished": "pol", "ground": "grnd",
    "zincplated": "zp", "nickelplated": "np", "powdercoated": "pc", "castiron": "ci", "carbonsteel": "cs", "c": "",
}
# fixed values: sets of words that name one thing
ARTICLE_ALIASES = {("dowel",): ("dowel", "pin"), ("retaining", "ring"): ("circlip",), ("heatsink",): ("heat", "sink"), ("locknut",): ("lock", "nut"), ("oring",): ("o", "ring")}
MATERIALS = [
    (("stainless", "steel", "304"), "stainless 304"), (("stainless", "steel", "430"), "stainless 430"), (("stainless", "304"), "stainless 304"), (("stainless", "430"), "stainless 430"),
    (("aluminium", "5083"), "aluminium 5083"), (("aluminium", "7075"), "aluminium 7075"), (("cast", "iron"), "cast iron"), (("castiron",), "cast iron"),
    (("carbon", "steel"), "carbon steel"), (("carbonsteel",), "carbon steel"), (("c", "steel"), "carbon steel"), (("epdm", "rubber"), "epdm"), (("epdm",), "epdm"), (("ptfe",), "ptfe"),
    (("silicone", "rubber"), "silicone"), (("silicone",), "silicone"), (("acetal",), "acetal"), (("titanium",), "titanium"), (("copper",), "copper"), (("bronze",), "bronze"),
    (("polyamide", "66"), "polyamide"), (("polyamide",), "polyamide"), (("stainless", "steel"), "stainless"), (("stainless",), "stainless"), (("aluminium",), "aluminium"), (("steel",), "carbon steel"),
]
FINISHES = [
    (("zinc", "plated"), "zinc plated"), (("zincplated",), "zinc plated"), (("nickel", "plated"), "nickel plated"), (("nickelplated",), "nickel plated"),
    (("powder", "coated"), "powder coated"), (("powdercoated",), "powder coated"), (("black", "oxide"), "black oxide"), (("passivated",), "passivated"),
    (("phosphated",), "phosphated"), (("polished",), "polished"), (("ground",), "ground"), (("plain",), "plain"), (("zinc",), "zinc plated"), (("nickel",), "nickel plated"),
]
FILLERS = {"", "N/A", "NA", "N.A.", "#N/A", "TBD", "TBC", "TBA", "NONE", "NULL", "NIL", "UNKNOWN", "NOT AVAILABLE", "NOT APPLICABLE", "TO BE DEFINED", "TO BE CONFIRMED", "DUMMY", "UNDEFINED", "SEE DWG", "SEE DRAWING"}


def says_nothing(value: str | None) -> bool:
    """True for texts that merely fill a field: blank, without letter or digit, a placeholder word, or one of X only."""
    v = (value or "").strip().upper()
    return v in FILLERS or not any(ch.isalnum() for ch in v) or (len(v) > 1 and set(v) == {"X"})


def slips(word: str) -> set[str]:
    """What one slip makes of a word of four letters or more."""
    if len(word) < 4:
        return set()
    dropped = {word[:i] + word[i + 1 :] for i in range(len(word))}
    doubled = {word[: i + 1] + word[i:] for i in range(len(word))}
    swapped = {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}
    return (dropped | doubled | swapped) - {word}


def _lexicon() -> tuple[dict[str, str], dict[str, set[str]]]:
    """Surface to word; slip to the words it may stand for."""
    exact = {s: w for w, forms in WORDS.items() for s in [w, *forms.split()]}
    slipped: dict[str, set[str]] = {}
    for surface, word in exact.items():
        for s in slips(surface):
            if s not in exact:
                slipped.setdefault(s, set()).add(word)
    return exact, slipped


EXACT, SLIPPED = _lexicon()
ARTICLES = {frozenset(a) for a in (
    "o ring|flat gasket|heat sink|end cap|lock nut|stud bolt|hose fitting|lip seal|shim ring|spur wheel|base frame|inductor coil|ball bearing|dowel pin|stator core|guide rail|"
    "linear guide|hex screw|worm wheel|pipe elbow|clamp ring|chain link|rotor hub|check valve|drive shaft|pressure plate|clevis|manifold block|rivet|nozzle|roller bearing|"
    "terminal strip|circlip|mounting brace|cable gland|adapter sleeve|split pin"
).split("|") for a in [a.split()]}

_NUMBER, _UNIT = r"(\d+(?:\.\d+)?)", r"(mm|cm|m|in|inch|inches|\"|″)?"
_END = r"(?![\w\"″])"
_LD = re.compile(rf"\bl\s*=?\s*{_NUMBER}\s*{_UNIT}\s*[,;]?\s*d\s*=?\s*{_NUMBER}\s*{_UNIT}{_END}")
_DL = re.compile(rf"\bd\s*=?\s*{_NUMBER}\s*{_UNIT}\s*[,;]?\s*l\s*=?\s*{_NUMBER}\s*{_UNIT}{_END}")
#: two sizes, or three that all stand behind x or *; the first may be a thread of metric sizes
_BY = re.compile(rf"(?<![a-z\d.])m?{_NUMBER}\s*{_UNIT}\s*[x*/×]\s*{_NUMBER}\s*{_UNIT}(?:\s*[x*×]\s*{_NUMBER}\s*{_UNIT})?{_END}")
#: fractions of an inch, with or without whole inches
_FRACTION = re.compile(r"(?<![\d./])(?:(\d+)[ -])?(\d+)/(\d+)\s*(in\b|inch\b|inches\b|\"|″)")
_FACTOR = {"mm": 1.0, "cm": 10.0, "m": 1000.0} | dict.fromkeys(("in", "inch", "inches", '"', "″"), 25.4)


def _mm(number: str, unit: str | None) -> str:
    return f"{float(number) * _FACTOR[unit or 'mm']:.3f}".rstrip("0").rstrip(".")


def _inches(m: re.Match) -> str:
    whole, top, bottom = m.groups()[:3]
    return f"{int(whole or 0) + int(top) / int(bottom):.6f}in" if int(bottom) else m.group()


def _by_words(table: list[tuple[tuple[str, ...], str]]) -> tuple[dict[tuple[str, ...], tuple[int, str]], int]:
    """The table's entries by their sorted words with their rank, and the most words of one."""
    out: dict[tuple[str, ...], tuple[int, str]] = {}
    for rank, (phrase, name) in enumerate(table):
        out.setdefault(tuple(sorted(phrase)), (rank, name))
    return out, max(map(len, out))


_MATERIALS, _FINISHES = _by_words(MATERIALS), _by_words(FINISHES)
#: no reading of more words can be a known article with its material and finish
MOST_WORDS = max(len(a) for a in ARTICLES | {frozenset(k) for k in ARTICLE_ALIASES}) + _MATERIALS[1] + _FINISHES[1]


def _pick(words: list[str], table: tuple[dict[tuple[str, ...], tuple[int, str]], int]) -> tuple[str | None, list[str]]:
    """The first entry of the table that stands in words side by side, in any order; the rest of the words."""
    entries, most = table
    best = None
    for n in range(1, min(most, len(words)) + 1):
        for i in range(len(words) - n + 1):
            got = entries.get(tuple(sorted(words[i : i + n])))
            if got and (best is None or (got[0], i) < best[:2]):
                best = got[0], i, n, got[1]
    return (None, words) if best is None else (best[3], words[: best[1]] + words[best[1] + best[2] :])


def _attempt(words: list[str]) -> tuple[str, str, str, bool]:
    material, rest = _pick(words, _MATERIALS)
    finish, rest = _pick(rest, _FINISHES)
    article = tuple(sorted(rest))
    article = tuple(sorted(ARTICLE_ALIASES.get(article, article)))
    known = frozenset(article) in ARTICLES
    return " ".join(article), material or "", finish or "plain", known and material is not None


def parse(text: str | None) -> tuple[str, str, str, str] | None:
    """(article, material, finish, sizes) of a description in normal form; None if it says nothing.

    sizes: the sizes in mm, diameter or first size before length, a third one last. Words that aren't known stay part of the article,
    so unknown texts are equal only if they consist of the same words. A slip that may stand for several words takes the reading that makes
    the whole known, else the first in the alphabet. Texts of any length are read whole.
    """
    if says_nothing(text):
        return None
    s = unicodedata.normalize("NFKC", text).lower()
    s = re.sub(r"p\.\s?t\.\s?f\.\s?e\.?", "ptfe", s)
    s = re.sub(r"(\d),(\d)", r"\1.\2", s)
    s = _FRACTION.sub(_inches, s)
    sizes: list[str] = []
    for pattern, turn in ((_LD, True), (_DL, False), (_BY, False)):
        if m := pattern.search(s):
            numbers, units = m.groups()[::2], m.groups()[1::2]
            last = next((u for u in reversed(units) if u), None)
            sizes = [_mm(x, u or last) for x, u in zip(numbers, units) if x]
            sizes = sizes[::-1] if turn else sizes
            s = s[: m.start()] + " " + s[m.end() :]
            break
    raw = re.findall(r"[^\W\d_]+|\d+(?:\.\d+)?", s)
    options = [[EXACT[w]] if w in EXACT else sorted(SLIPPED.get(w, (w,))) for w in raw]
    first = [o[0] for o in options]
    best = _attempt(first)
    if not best[3] and len(raw) <= MOST_WORDS and any(len(o) > 1 for o in options):
        best = next((got for got in map(_attempt, map(list, itertools.product(*options))) if got[3]), best)
    return best[0], best[1], best[2], "x".join(sizes)


def is_known(article: str, material: str) -> bool:
    """Whether a reading consists of known words only."""
    return bool(material) and frozenset(article.split()) in ARTICLES


def shortens(short: str, long: str) -> bool:
    """Whether a word may be an abbreviation of another: same first letter, its letters in the order of the other's, and fewer."""
    rest = iter(long)
    return 1 < len(short) < len(long) and short[0] == long[0] and all(c in rest for c in short)


def paired(a: list[str], b: list[str]) -> list[tuple[str, str]] | None:
    """(short, long) of the words of two wordings of one thing, if all their other words are equal and each of these abbreviates just one; else None."""
    left, right = [x for x in a if x not in b], [x for x in b if x not in a]
    if len(left) != len(right):
        return None
    out = []
    for x in left:
        fits = [(x, y) if shortens(x, y) else (y, x) for y in right if shortens(x, y) or shortens(y, x)]
        if len(fits) != 1:
            return None
        out += fits
    return out if len({y if y in right else x for x, y in out}) == len(right) else None


def maker_key(value: str | None) -> str | None:
    """Maker number in normal form: letters and digits in upper case; None if it says nothing or has no digit but 0."""
    v = re.sub(r"[^A-Z0-9]", "", unicodedata.normalize("NFKC", value or "").upper())
    return v if re.search("[1-9]", v) and not says_nothing(value) else None
