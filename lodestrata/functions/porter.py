"""Porter's stemmer (1980) with the usual extensions: a function, and SQL expressions that check it.

Both work on a word and its consonant-vowel pattern; the pattern of a beginning of a word is the
beginning of its pattern, and the measure m is the number of VC in it. The function serves workers,
which stem each different word once, and queries on the driver. The expressions are the oracle's.
"""

from __future__ import annotations

#: Words with a stem of their own.
IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
             "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
#: Suffixes of steps 2, 3 and 4.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
         ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _by_end(rules) -> dict[str, list[tuple[str, str]]]:
    """Rules by the last two letters of their suffixes, each list in the rules' order."""
    out: dict[str, list[tuple[str, str]]] = {}
    for suffix, other in rules:
        out.setdefault(suffix[-2:], []).append((suffix, other))
    return out


_STEP2, _STEP3, _STEP4 = map(_by_end, (STEP2, STEP3, [(x, "") for x in STEP4]))
#: Last two letters of words that some rule may change, but for those that end in e, s or y.
_ENDS = frozenset((*_STEP2, *_STEP3, *_STEP4, "ed", "ng", "gi", "ll"))
_SHAPES = {k: "V" if chr(k) in "aeiou" else "C" for k in range(128)}


def _shape(w: str) -> str:
    """C and V for each character; y is C at the beginning and behind a vowel."""
    if w.isascii() and "y" not in w:
        return w.translate(_SHAPES)
    out = ""
    for c in w:
        out += "V" if c in "aeiou" or c == "y" and out[-1:] == "C" else "C"
    return out


def _short(w: str, p: str) -> bool:
    return p == "VC" or p.endswith("CVC") and w[-1] not in "wxy"


def _by_rules(w: str, rules: dict[str, list[tuple[str, str]]], least: int) -> str:
    for suffix, other in rules.get(w[-2:], ()):
        if w.endswith(suffix):
            n = len(w) - len(suffix)
            fits = _shape(w[:n]).count("VC") > least and (suffix != "ion" or w[n - 1:n] in ("s", "t"))
            return w[:n] + other if fits else w
    return w


def _inflection(w: str) -> str:
    """Plurals, then past tense and -ing, then final y."""
    if w[-1:] == "s":
        if w.endswith("ies"):
            w = w[:-1] if len(w) == 4 else w[:-2]
        elif w.endswith("sses"):
            w = w[:-2]
        elif not w.endswith("ss"):
            w = w[:-1]
    cut = 0
    if w[-2:] == "ed":
        if w.endswith("ied"):
            w = w[:-1] if len(w) == 4 else w[:-2]
        elif w.endswith("eed"):
            w = w[:-1] if "VC" in _shape(w[:-3]) else w
        elif "V" in _shape(w[:-2]):
            cut = 2
    elif w.endswith("ing") and "V" in _shape(w[:-3]):
        cut = 3
    if cut:
        w = w[:-cut]
        p = _shape(w)
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif p.endswith("CC") and w[-1] == w[-2] and w[-1] not in "lsz":
            w = w[:-1]
        elif p.count("VC") == 1 and _short(w, p):
            w += "e"
    if w[-1:] == "y" and len(w) > 2 and _shape(w)[-2] == "C":
        w = w[:-1] + "i"
    return w


def _derivation(w: str) -> str:
    if w.endswith("logi"):
        return w[:-1] if "VC" in _shape(w[:-3]) else w
    out = _by_rules(w, _STEP2, 0)
    # what loses -alli is tried once more
    return _derivation(out) if out != w and w.endswith("alli") else out


def stem(word: str) -> str:
    """Stem of a lower-case word."""
    if len(word) <= 2 or word in IRREGULAR:
        return IRREGULAR.get(word, word)
    if word[-1] not in "esy" and word[-2:] not in _ENDS:
        return word
    w = _derivation(_inflection(word))
    w = _by_rules(_by_rules(w, _STEP3, 0), _STEP4, 1)
    if w.endswith("e"):
        p = _shape(w)[:-1]
        if p.count("VC") > 1 or "VC" in p and not _short(w[:-1], p):
            w = w[:-1]
    if w.endswith("ll") and _shape(w)[:-1].count("VC") > 1:
        w = w[:-1]
    return w


def _stem(n: int, x: str = "w") -> str:
    return f"left({x}, length({x}) - {n})"


def _rules(rules, when: str) -> str:
    """CASE over (suffix, replacement): the first suffix that fits decides, and acts if its stem fits."""
    arms = "".join(f" when w like '%{s}' then case when {when.format(p=_stem(len(s), 'p'), w=_stem(len(s)))} then concat({_stem(len(s))}, '{r}') else w end" for s, r in rules)
    return f"case{arms} else w end"


def _cvc(w: str, p: str) -> str:
    """Ends consonant, vowel, consonant, the last not w, x, y; or is vowel and consonant."""
    return f"(({p} like '%CVC' and right({w}, 1) not in ('w', 'x', 'y')) or {p} = 'VC')"


def pattern(w: str) -> str:
    """C and V for each letter; y is C at the beginning and behind a vowel."""
    p = f"translate(regexp_replace({w}, '[^aeiouy]', 'C', 'g'), 'aeiou', 'VVVVV')"
    p = f"replace(concat('>', {p}), '>y', '>C')"
    for _ in range(3):
        p = f"replace(replace({p}, 'Cy', 'CV'), 'Vy', 'VC')"
    return f"replace({p}, '>', '')"


def steps(word: str) -> list[tuple[str, str]]:
    """(column, expression) to add one after the other; the last w is the stem. word is lower case."""
    undone = f"case when w like '%at' or w like '%bl' or w like '%iz' then concat(w, 'e') when p like '%CC' and right(w, 1) = left(right(w, 2), 1) and right(w, 1) not in ('l', 's', 'z') then {_stem(1)} " \
             f"when p like '%VC%' and p not like '%VC%VC%' and {_cvc('w', 'p')} then concat(w, 'e') else w end"
    out = [("w", word), ("p", pattern("w"))]
    out += [("w", f"case when w like '%ies' then case when length(w) = 4 then {_stem(1)} else {_stem(2)} end when w like '%sses' then {_stem(2)} when w like '%ss' then w when w like '%s' then {_stem(1)} else w end")]
    out += [("p", pattern("w")), ("cut", f"case when w like '%ied' or w like '%eed' then 0 when w like '%ed' and {_stem(2, 'p')} like '%V%' then 2 when w like '%ing' and {_stem(3, 'p')} like '%V%' then 3 else 0 end")]
    out += [("w", f"case when w like '%ied' then case when length(w) = 4 then {_stem(1)} else {_stem(2)} end when w like '%eed' then case when {_stem(3, 'p')} like '%VC%' then {_stem(1)} else w end when cut > 0 then left(w, length(w) - cut) else w end"), ("p", pattern("w"))]
    out += [("w", f"case when cut > 0 then {undone} else w end"), ("p", pattern("w"))]
    out += [("w", f"case when w like '%y' and length(w) > 2 and {_stem(1, 'p')} like '%C' then concat({_stem(1)}, 'i') else w end"), ("p", pattern("w"))]
    two = _rules(STEP2, "{p} like '%VC%'")
    logi = f"case when w like '%logi' then case when {_stem(3, 'p')} like '%VC%' then {_stem(1)} else w end else {two} end"
    # what loses -alli is tried once more
    out += [("again", f"w like '%alli' and {_stem(4, 'p')} like '%VC%'"), ("w", logi), ("p", pattern("w")), ("w", f"case when again then {logi} else w end"), ("p", pattern("w"))]
    out += [("w", _rules(STEP3, "{p} like '%VC%'")), ("p", pattern("w"))]
    four = _rules([(s, "") for s in STEP4], "{p} like '%VC%VC%'").replace(f"when w like '%ion' then case when {_stem(3, 'p')} like '%VC%VC%'", f"when w like '%ion' then case when {_stem(3, 'p')} like '%VC%VC%' and right({_stem(3)}, 1) in ('s', 't')")
    out += [("w", four), ("p", pattern("w"))]
    out += [("w", f"case when w like '%e' and ({_stem(1, 'p')} like '%VC%VC%' or {_stem(1, 'p')} like '%VC%' and not {_cvc(_stem(1), _stem(1, 'p'))}) then {_stem(1)} else w end"), ("p", pattern("w"))]
    out += [("w", f"case when w like '%ll' and {_stem(1, 'p')} like '%VC%VC%' then {_stem(1)} else w end")]
    odd = " ".join(f"when '{a}' then '{b}'" for a, b in IRREGULAR.items())
    return [*out, ("w", f"case when length({word}) <= 2 then {word} else case {word} {odd} else w end end")]


def stem_sql(source: str, word: str, to: str) -> str:
    """SQL that adds the stem to a subquery; its own columns w, p, cut and again stay."""
    q = source
    for name, e in steps(word):
        q = f"select * {'exclude (' + name + ') ' if f' as {name} from' in q else ''}, {e} as {name} from ({q})"
    return f"select *, w as {to} from ({q})"
