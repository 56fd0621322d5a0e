"""Personal information in free text, found by a semi-Markov conditional random field.

Whole spans are the unit. Shapes propose segments that hold digits or an at-sign; every run of two to five words in
the order of a name's parts is proposed as a person, listed or not. Features of the whole span and of its
neighbourhood score a segment: order and case, its words' letters, length and rank in a public vocabulary, lists,
cues before and after. A dynamic programme over segments, with transitions between one mention and the next, chooses
the boundaries and kinds of all mentions of a text jointly. The weights are fitted here by maximum likelihood
(forward-backward over the same lattice) on sentences made in :mod:`pii_training`.
"""

from __future__ import annotations

import base64
import json
import math
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import GIVEN, NICKNAMES, STATES, TITLES, TRADE_SHORT, TRADES, given_names
from .tokens import VOCABULARY

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[STREET_ADDRESS]", "person_name": "[PERSON_NAME]"}
#: Sentences the weights are fitted on, rounds of fitting, and the generator's seed.
SENTENCES, ROUNDS, SEED = 9000, 10, 11
#: Rounds before these in which each candidate is taken by itself.
WARM = 90
#: Added to the score of every candidate name: in doubt a name is covered rather than shown.
LEAN = 1.0
#: A second public vocabulary, of lower-case words: tells words that are written at all from those nobody else writes.
WORDS = "/opt/tokenizers/word_bpe_49k.json"
#: Words of a name at most; spans of digits and at-signs are bounded by their shapes.
LONGEST = 5

# ---- fixed values: cues and shapes --------------------------------------------------------------------

_CUES = {
    "phone": "call callback ring phone mobile tel telephone fax cell text whatsapp dial hotline topup",
    "id_number": "ssn itin nino dni nie ni no passport tax steuer lic licence license driver social security insurance id identity person bsn pesel cpf",
    "not_personal": "trace serial inv invoice part order conf confirmation auth check cheque batch card ref docket store terminal room tbl gift seq acct account claim#",
    "person": "attn zelle venmo xfer app iou-app cash payee recipient beneficiary name tenant landlord",
    "near_person": "from to by with for and",
    "address": "deliver delivered moved service keys repair rent at to visit address live lives",
}
_CUE_OF = {w: k for k, v in reversed(_CUES.items()) for w in v.split()}
_PARTICLES = frozenset("DE DER DEN DI DA DO DOS DU LA LE VAN VON BIN AL EL TER Y ZU".split())
_STREET_US = "st street ave avenue rd road blvd boulevard lane ln court ct way dr drive terrace ter place pl square sq close crescent parkway pkwy hill row"
_US = "|".join(_STREET_US.split())
_FIRST = r"(?:rua|calle|c/|via|viale|avenida|av\.|plaza|piazza|corso|paseo|praça|travessa|camino|largo)"
_FRENCH = r"(?:rue|avenue|boulevard|quai|place|impasse|chemin|allée)"

_SHAPES: tuple[tuple[str, str, re.Pattern[str]], ...] = tuple(
    (kind, name, re.compile(p, re.IGNORECASE))
    for kind, name, p in (
        ("email", "plain", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
        ("email", "spelt", r"[\w.+-]+\s*(?:\(at\)|\[at\])\s*[\w-]+(?:(?:\.|\s(?:dot)\s)[\w-]+)+"),
        ("email", "words", r"[\w.+-]+(?: dot [\w+-]+)* at [\w-]+(?: dot [\w-]+)+"),
        ("email", "dots", r"[\w.+-]+(?: dot [\w+-]+)+ ?(?:@|\(at\)) ?[\w-]+(?:(?:\.| dot )[\w-]+)+"),
        ("phone", "world", r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,12}(?:[ ./-]\d{2,8}){0,4}(?:\s?(?:x|ext\.?)\s?\d{1,5})?"),
        ("phone", "area", r"(?<![\d-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])(?:\s?(?:x|ext\.?)\s?\d{1,5})?"),
        ("phone", "local", r"(?<![\d-])\d{3}[-.]\d{4}(?![\d-])"),
        ("phone", "trunk", r"(?<![\d-])0\d{2,4}[ /]\d{3,5}[ -]\d{3,4}(?!\d)"),
        ("phone", "any", r"(?<![\w.,-])\+?\(?\d[\d().\-/ ]{5,16}\d(?![\w-]|[.,]\d)"),
        ("phone", "run", r"(?<![\d-])\d{10,11}(?![\d-])"),
        ("id_number", "3-2-4", r"(?<![\d-])\d{3}[ -]\d{2}[ -]\d{4}(?![\d-])"),
        ("id_number", "nine", r"(?<![\dA-Z-])\d{9}(?![\dA-Z-])"),
        ("id_number", "2-7", r"(?<![\d-])\d{2}-\d{7}(?![\d-])"),
        ("id_number", "letters-six-letter", r"(?<![\w-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w-])"),
        ("id_number", "eight-letter", r"(?<![\w-])[XYZ]?\d{7,8}-?[A-Z](?![\w-])"),
        ("id_number", "letters-seven", r"(?<![\w-])[A-Z]{1,2}\d{7,8}(?![\w-])"),
        ("id_number", "letter-3-4-4", r"(?<![\w-])[A-Z]\d{3}-\d{4}-\d{4}(?![\w-])"),
        ("id_number", "number-any", r"(?<![\w-])(?=[A-Z]*(?:\d[A-Z]?){6})[A-Z0-9]{6,14}(?![\w-])"),
        ("id_number", "2-3-3-3", r"(?<![\d-])\d{2} \d{3} \d{3} \d{3}(?![\d-])"),
        ("street_address", "number-first", rf"(?<![\w#*-])\d{{1,5}}(?: (?:N|S|E|W|NE|NW|SE|SW)\.?)?(?: [^\W\d_]+){{1,3}}? (?:{_US})\b\.?(?:,? (?:Apt|Unit|Suite|Ste|#) ?\w+)?(?:, [^\W\d_]+(?: [^\W\d_]+){{0,2}} [A-Z]{{2}}(?: \d{{5}})?)?"),
        ("street_address", "number-last", rf"(?<!\w){_FIRST}(?: [^\W\d_]+){{1,4}},? \d{{1,4}}\b(?:, ?\d{{1,2}}\.? ?(?:[A-Z]\b|OG|º)?)?"),
        ("street_address", "number-french", rf"(?<![\w#*-])\d{{1,4}}(?: ?bis|ter)?,? {_FRENCH}(?: (?:de la|du|des|de|d'|l'|la|le|les))?(?: [^\W\d_]+){{1,3}}?(?=$|[^\w\s]|\s(?:may|for|with|re|[^\w\s]))"),
        ("street_address", "any", r"(?<![^\W\d_])[^\W\d_]{4,}(?: [^\W\d_]+){0,2} \d{1,4}[A-Za-z]?(?![\w-]|[.,]\d)"),
        ("street_address", "number-nordic", r"\b[^\W\d_]+(?:gatan|vägen|gade|vej|veien|gata|straat|laan|gracht|plein|utca|katu|tie)(?: \d{1,4}[a-z]?)\b"),
        ("street_address", "number-german", r"\b[^\W\d_]+(?:str\.|straße|strasse|gasse|weg|platz|allee|ufer|damm|ring) \d{1,4}[a-z]?\b(?: Hinterhaus|,? ?\d{1,2}\. ?(?:OG|Stock)|, ?\d{1,2}\b)?"),
    )
)
#: Shapes that ordinary numbers have too.
_LOOSE, _BARE = frozenset(("any", "number-any")), frozenset(("local", "run", "nine"))
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|[^\w\s]|_")
_NUMBER_FIRST = frozenset(("number-first", "number-french"))
_NUMBER_WORD, _WORD_NUMBER = re.compile(r"\d(?: ?bis|ter)?,? [^\W\d_]", re.IGNORECASE), re.compile(r"[^\W\d_][.,]?,? \d")
_FEWEST = {"phone": 7, "id_number": 6, "street_address": 1}
_HINT = re.compile(r"[@\d]|\bat\b|\(at\)", re.IGNORECASE)
_PLAIN = re.compile(r"[^@_+#<]*")
_DIGITS = re.compile(r"\d+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


class Candidate(NamedTuple):
    kind: str
    first: int  # token range [first, last)
    last: int
    features: tuple[str, ...]
    words: tuple[tuple[str, str], ...] = ()  # (place in the name, word), each with the features of the word


def tokens_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


# ---- words ------------------------------------------------------------------------------------------------


@lru_cache(2)
def vocabulary(path: str = VOCABULARY) -> tuple[dict[str, str], dict[str, str]]:
    """(small, large): how frequent a word is written small, and with a capital, in the public vocabulary: A, B or C."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary file at {path}")
    small: dict[str, str] = {}
    large: dict[str, str] = {}
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            word = base64.b64decode(token)
            if len(word) > 2 and word[:1] == b" " and word[1:].isalpha() and word[2:].islower():
                text, n = word[1:].decode(), int(rank)
                (small if text.islower() else large)[text.lower()] = "A" if n < 4000 else "B" if n < 16000 else "C"
    return small, large


@lru_cache(2)
def written_words(path: str = WORDS) -> frozenset[str]:
    """Words of three letters or more that the second vocabulary holds whole."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary file at {path}")
    with open(path, encoding="utf-8") as f:
        held = json.load(f)["model"]["vocab"]
    return frozenset(w[:-4] for w in held if w.endswith("</w>") and len(w) > 6 and w[:-4].isalpha())


@lru_cache(200_000)
def _kind_of(word: str) -> str:
    """What a token can be in a name: Title, Initial, Given, near-given, particle, trade word (x), or another word (S); '' for no word."""
    if not word[0].isalpha():
        return "," if word == "," else ""
    if word in TITLES:
        return "T"
    if len(word) == 1:
        return "I"
    if word in GIVEN or word in NICKNAMES:
        return "G"
    if word in TRADES or word in TRADE_SHORT or len(word) > 4 and any(t.startswith(word) for t in TRADES):
        return "x"
    if word in _PARTICLES:
        return "p"
    return "g" if len(word) > 4 and given_names(word) else "S"


@lru_cache(200_000)
def _common(word: str) -> str:
    """Frequency of a word written small and with a capital, and whether the second vocabulary holds it, e.g. ``A-+``."""
    small, large = vocabulary()
    w = word.lower()
    return small.get(w, "-") + large.get(w, "-") + ("+" if w in written_words() else "-")


def _word_features(word: str, listed: bool) -> list[str]:
    """Features of a word by itself; a word that is listed is read as any other if ``listed`` is false."""
    w, kind = word.lower(), _kind_of(word)
    edge = f"^{w}$"
    return [*_word_shape(word, "S" if kind in "Gg" and not listed else kind), *(f"letters={edge[i : i + 3]}" for i in range(len(edge) - 2)), f"end={w[-2:]}", f"end={w[-3:]}"]


def _word_shape(word: str, kind: str) -> list[str]:
    w, common = word.lower(), _common(word)
    out = [f"kind={kind}", f"size={min(len(w), 12)}", f"vocabulary={common}", f"kind={kind}{common}"]
    if len(w) > 2 and not any(c in "aeiouyäöüáéíóúàèìòùåøæ" for c in w):
        out.append("no_vowel")
    if not w.isascii():
        out.append("accent")
    return out


# ---- candidates --------------------------------------------------------------------------------------------

#: Orders of the parts of a name, N being any word; a dot may follow an initial or a title.
_ORDERS = ("NN", "NNN", "NIN", "NIIN", "IN", "IIN", "INN", "TN", "TNN", "TIN", "TNIN", "TNNN", "N,N", "N,I", "N,II", "N,NI", "N,NN", "NI", "NNI", "NpN", "NppN", "NNpN", "NNppN", "TpN", "TNpN", "IpN")
_STARTS = {o[:i] for o in _ORDERS for i in range(1, len(o) + 1)}
_FULL = frozenset(_ORDERS)
#: What may stand right before a name; after anything else its first letters are the rest of another word.
_BEFORE = frozenset(" \t\r\n\xa0*(<[\"/|;:,.-=>")
#: What may stand right behind one; a sign there is the middle of a word that was decoded wrongly.
_AFTER = frozenset(" \t\r\n\xa0*)>]\"/|;:,.-=!?'’#&@_+<(") | frozenset("0123456789")
_AS_ORDER = {"T": "T", "I": "I", "p": "p", ",": ",", "G": "N", "g": "N", "S": "N", "x": "N"}


def _name_spans(kinds: list[str], spans: list[tuple[int, int]], text: str) -> Iterator[tuple[int, int, str, tuple[int, ...]]]:
    """(first, last, order, places of the words) of every run of words that has the order of a name's parts."""
    n = len(kinds)
    for i, kind in enumerate(kinds):
        if not kind or kind == "," or (spans[i][0] and text[spans[i][0] - 1] not in _BEFORE):
            continue
        order, j, used = "", i, []
        while j < n:
            a = spans[j][0]
            gap = text[spans[j - 1][1] : a] if j > i else ""
            if not kinds[j] and j > i and text[a] == "." and not gap and kinds[j - 1] in ("T", "I"):
                if order in _FULL and order[-1] == "I":
                    yield i, j + 1, order, tuple(used)
                j += 1
                continue
            if not kinds[j] or gap not in ("", " ", "  "):
                break
            letter = _AS_ORDER[kinds[j]]
            if letter == "p" and order + "p" not in _STARTS:
                letter = "N"
            order += letter
            if order not in _STARTS or len(used) == LONGEST:
                break
            if kinds[j] != ",":
                used.append(j)
            j += 1
            if order in _FULL and (spans[j - 1][1] == len(text) or text[spans[j - 1][1]] in _AFTER) and not (order[-1] == "I" and j < n and text[spans[j][0]] == "." and spans[j][0] == spans[j - 1][1]):
                yield i, j, order, tuple(used)


def _places(order: str, used: tuple[int, ...], kinds: list[str]) -> list[tuple[str, int]]:
    """Which of a name's words stands in a given name's place (a), in the surname's (b), or between (m)."""
    words = [k for k in used if kinds[k] in "GgSxp"]
    if not words:
        return []
    if "," in order:
        return [("b", words[0]), *(("a", k) for k in words[1:2]), *(("m", k) for k in words[2:])]
    if len(words) == 1:
        return [("s", words[0])]
    if order[0] in "TI" and len(words) == 1:
        return [("b", words[0])]
    return [("a", words[0]), *(("m", k) for k in words[1:-1]), ("b", words[-1])]


@lru_cache(200_000)
def _class_of(w: str) -> str:
    """Class of a token beside a name: punctuation, a number, a cue, a trade word or how common it is."""
    if w[0].isdigit():
        return "number"
    if not w[0].isalpha():
        return w if w in ",;.|/*#@_+<" else "mark"
    if w in TRADES or w in TRADE_SHORT or len(w) > 4 and any(t.startswith(w) for t in TRADES):
        return "trade"
    cue = _CUE_OF.get(w.lower())
    return "cue:" + cue if cue else "state" if w in STATES else "word" + _common(w)


def _name_context(i: int, j: int, order: str, used: tuple[int, ...], letters: str, words: list[str], spans: list[tuple[int, int]], text: str, signs: bool) -> tuple:
    """What is known of a candidate name beside its words, as one key; :func:`_context_features` spells it out."""
    case = ""
    for k in used:
        a, b = spans[k]
        if b - a > 1:
            raw = text[a:b]
            now = "U" if raw == words[k] else "l" if raw.islower() else "T"
            if case and case != now:
                case = "mixed"
                break
            case = now
    before = after = "edge"
    if i:
        before = _class_of(words[i - 1]) if text[spans[i - 1][1] : spans[i][0]] in ("", " ", "  ") else "apart"
    if j < len(words):
        after = _class_of(words[j]) if text[spans[j - 1][1] : spans[j][0]] in ("", " ", "  ") else "apart"
    cues = tuple(sorted({c[4:] for w in words[max(0, i - 3) : i] if (c := _class_of(w))[:4] == "cue:"})) if i else ()
    glued = False
    if signs:
        around = text[max(0, spans[i][0] - 1) : spans[j - 1][1] + 1]
        glued = any(c in around for c in "@_+#<") or (j < len(words) and words[j] in "@_+")
    return order, letters, case + _common(words[used[-1]]), before, after, cues, glued, i == 0, j == len(words)


def _context_features(key: tuple) -> list[str]:
    order, letters, case, before, after, cues, glued, opens, closes = key
    out = ["bias", f"order={order}", f"letters={letters}", f"order={order}/{letters}", f"case={case[:-3]}", f"case={case}/{after[:4]}", f"last={letters}/{case[-3:]}", f"last={letters}/{case[-3:]}/{after[:4]}", f"before={before}", f"after={after}", f"after={after}/{letters}"]
    out += [f"cue={c}" for c in cues] or ["cue=none"]
    out += [f"cue={c}/{letters}" for c in cues]
    if glued:
        out.append("glued")
    if opens and closes:
        out += ["whole", f"whole={letters}"]
    elif opens:
        out.append("opens")
    elif closes:
        out.append("closes")
    return [f"person_name:{f}" for f in out]


def _shaped(text: str, words: list[str], spans: list[tuple[int, int]]) -> Iterator[Candidate]:
    """Segments with digits or an at-sign."""
    first = {a: i for i, (a, _) in enumerate(spans)}
    last = {b: i + 1 for i, (_, b) in enumerate(spans)}
    out: dict[tuple[str, int, int], set[str]] = {}
    digits = sum(map(len, _DIGITS.findall(text)))
    sign, spelt = "@" in text or "at)" in text or "AT)" in text, " dot " in text or " DOT " in text or " Dot " in text
    number_first, number_last = _NUMBER_WORD.search(text), _WORD_NUMBER.search(text)
    for kind, name, shape in _SHAPES:
        # no shape of a kind fits a text without its least number of digits, or without a sign of an address of mail
        if digits < _FEWEST.get(kind, 0) or kind == "email" and not (sign if name in ("plain", "spelt") else spelt):
            continue
        if kind == "street_address" and not (number_first if name in _NUMBER_FIRST else number_last):
            continue
        for m in shape.finditer(text):
            a, b = first.get(m.start()), last.get(m.end())
            if a is not None and b is not None:
                feats = out.setdefault((kind, a, b), set())
                feats.add(f"shape={name}")
                if name in _LOOSE and kind != "street_address":
                    runs = [str(len(r)) for r in _DIGITS.findall(m[0])]
                    feats.update((f"digits={sum(map(int, runs))}", f"groups={'-'.join(runs)}", f"start={m[0][0] if m[0][0] in '+(0' else 'other'}"))
    for (kind, a, b), feats in out.items():
        near = [w.lower() for w in words[max(0, a - 4) : a] if w[0].isalpha()]
        cues = {_CUE_OF[w] for w in near[-3:] if w in _CUE_OF}
        loose = all(f[6:] in _LOOSE for f in feats if f.startswith("shape="))
        if loose:
            feats |= {f"loose={c}" for c in cues} or {"loose=none"}
        else:  # what ordinary numbers share says nothing beside a shape of its own
            feats = {f for f in feats if not f.startswith(("digits=", "groups=", "start=")) and f[6:] not in _LOOSE}
        feats |= {f"cue={c}" for c in cues} or {"cue=none"}
        if b < len(words) and words[b][0].isdigit() and spans[b][0] == spans[b - 1][1]:
            feats.add("digit_after")
        yield Candidate(kind, a, b, tuple(f"{kind}:{f}" for f in sorted(feats | {"loose" if loose else "bias"})))


def _read(text: str) -> tuple[list[tuple[int, int]], list[str], list[str]]:
    spans = tokens_of(text)
    words = [text[a:b].upper() for a, b in spans]
    return spans, words, [_kind_of(w) for w in words]


def candidates(text: str, listed: bool = True) -> tuple[list[tuple[int, int]], list[Candidate]]:
    """Tokens of a text and the candidate segments on them, with their features; without the lists of given names if ``listed`` is false."""
    spans, words, kinds = _read(text)
    got = list(_shaped(text, words, spans)) if _HINT.search(text) else []
    for i, j, order, used in _name_spans(kinds, spans, text):
        key = _name_context(i, j, order, used, "".join(kinds[k] if listed or kinds[k] not in "Gg" else "S" for k in used), words, spans, text, True)
        got.append(Candidate("person_name", i, j, tuple(_context_features(key)), tuple((p, words[k]) for p, k in _places(order, used, kinds))))
    return spans, got


def features_of(c: Candidate, listed: bool = True) -> list[str]:
    """All features of a candidate, those of its words included."""
    return [*c.features, *(f"person_name:{place}:{f}" for place, word in c.words for f in _word_features(word, listed))]


# ---- the random field ------------------------------------------------------------------------------------

_START = len(KINDS)  # the state before the first mention
_STATE = {k: i for i, k in enumerate(KINDS)}
_NEVER = float("-inf")


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top if top == _NEVER else top + math.log(sum(math.exp(v - top) for v in values))


def _lattice(cands: list[tuple[int, int, int]]) -> tuple[list[int], list[list[int]], dict[int, int]]:
    """(places, candidates by end, place -> index): only the ends of candidates matter, all else is passed over at no cost."""
    places = sorted({0, *(c[1] for c in cands), *(c[2] for c in cands)})
    at = {p: i for i, p in enumerate(places)}
    ends: list[list[int]] = [[] for _ in places]
    for i, c in enumerate(cands):
        ends[at[c[2]]].append(i)
    return places, ends, at


def marginals(cands: list[tuple[int, int, int]], scores: list[float], moves) -> tuple[list[float], np.ndarray]:
    """Probability of each candidate (state, first, last), and expected count of each transition, under all segmentations."""
    places, ends, at = _lattice(cands)
    fore = [[_NEVER] * _START + [0.0]]
    for p in range(1, len(places)):
        now = list(fore[-1])
        for i in ends[p]:
            k, first, _ = cands[i]
            now[k] = _log_sum([now[k], scores[i] + _log_sum([f + moves[s][k] for s, f in enumerate(fore[at[first]])])])
        fore.append(now)
    back = [[0.0] * (_START + 1) for _ in places]
    starts: list[list[int]] = [[] for _ in places]
    for i, c in enumerate(cands):
        starts[at[c[1]]].append(i)
    for p in range(len(places) - 1, -1, -1):
        here = list(back[p + 1]) if p + 1 < len(places) else back[p]
        for i in starts[p]:
            k, _, last = cands[i]
            ahead = scores[i] + back[at[last]][k]
            here = [_log_sum([h, moves[s][k] + ahead]) for s, h in enumerate(here)]
        back[p] = here
    total = _log_sum(fore[-1])
    out, steps = [], np.zeros((_START + 1, _START))
    for i, (k, first, last) in enumerate(cands):
        ahead, p = scores[i] + back[at[last]][k] - total, 0.0
        for s, f in enumerate(fore[at[first]]):
            if f > _NEVER:
                q = math.exp(f + moves[s][k] + ahead)
                steps[s, k] += q
                p += q
        out.append(p)
    return out, steps


def best_path(cands: list[tuple[int, int, int]], scores: list[float], moves) -> list[int]:
    """The candidates of the best segmentation, in order."""
    if len(cands) == 1:
        return [0] if scores[0] + moves[_START][cands[0][0]] > 0 else []
    places, ends, at = _lattice(cands)
    best = [[_NEVER] * _START + [0.0]]
    how: list[list] = [[None] * (_START + 1)]
    for p in range(1, len(places)):
        now, by = list(best[-1]), list(how[-1])
        for i in ends[p]:
            k, first, _ = cands[i]
            q = at[first]
            s = max(range(_START + 1), key=lambda x: best[q][x] + moves[x][k])  # noqa: B023
            if (v := best[q][s] + moves[s][k] + scores[i]) > now[k]:
                now[k], by[k] = v, (i, how[q][s])
        best.append(now)
        how.append(by)
    link = how[-1][max(range(_START + 1), key=lambda s: (best[-1][s], s))]
    out = []
    while link is not None:
        out.append(link[0])
        link = link[1]
    return out[::-1]


class Field:
    """Fitted weights, with the scores of words and contexts kept once computed."""

    def __init__(self, weights: dict[str, float], moves: list[list[float]]):
        self.weights, self.moves = weights, moves
        low, high = min(map(min, moves)), max(map(max, moves))
        self.spread = max(0.0, high) + high - low  # taking a segment out changes the moves around it by no more
        self.by_word: dict[tuple[str, str], float] = {}
        self.by_context: dict[tuple, float] = {}
        self.judged: dict[tuple[str, str], object] = {}
        self.letters: dict[str, dict[str, float]] = {place: {} for place in "abms"}
        for f, w in weights.items():
            place, _, rest = f.removeprefix("person_name:").partition(":")
            if place in self.letters and rest.startswith(("letters=", "end=")):
                self.letters[place][rest.partition("=")[2] + ("<" if rest[0] == "e" else "")] = w

    def __reduce__(self):
        import hashlib

        key = hashlib.sha256(repr((sorted(self.weights.items()), self.moves)).encode()).hexdigest()
        return _field_of, (key, self.weights, self.moves)

    def _of_word(self, key: tuple[str, str]) -> float:
        got = self.by_word.get(key)
        if got is None:
            if len(self.by_word) > 500_000:
                self.by_word.clear()
            place, word = key
            of, w = self.letters[place], word.lower()
            edge = f"^{w}$"
            got = of.get(w[-2:] + "<", 0.0) + of.get(w[-3:] + "<", 0.0)
            for i in range(len(edge) - 2):
                got += of.get(edge[i : i + 3], 0.0)
            for f in _word_shape(word, _kind_of(word)):
                got += self.weights.get(f"person_name:{place}:{f}", 0.0)
            self.by_word[key] = got
        return got

    def _of_context(self, key: tuple) -> float:
        got = self.by_context.get(key)
        if got is None:
            if len(self.by_context) > 200_000:
                self.by_context.clear()
            got = self.by_context[key] = sum(self.weights.get(f, 0.0) for f in _context_features(key))
        return got

    def score(self, c: Candidate) -> float:
        return sum(self.weights.get(f, 0.0) for f in features_of(c)) + LEAN * (c.kind == "person_name")

    def decode(self, text: str) -> list[Span]:
        """The best segmentation of a text; names that no path can gain from are passed over."""
        spans, words, kinds = _read(text)
        cands: list[tuple[int, int, int]] = []
        scores: list[float] = []
        if _HINT.search(text):
            for c in _shaped(text, words, spans):
                cands.append((_STATE[c.kind], c.first, c.last))
                scores.append(sum(self.weights.get(f, 0.0) for f in c.features))
        signs = not _PLAIN.fullmatch(text)
        for i, j, order, used in _name_spans(kinds, spans, text):
            letters = "".join([kinds[k] for k in used])
            s = 0.0
            for place, k in _places(order, used, kinds):
                key = place, words[k]
                got = self.by_word.get(key)
                s += self._of_word(key) if got is None else got
            context = _name_context(i, j, order, used, letters, words, spans, text, signs)
            got = self.by_context.get(context)
            s += self._of_context(context) if got is None else got
            s += LEAN
            if s + self.spread > 0:
                cands.append((_STATE["person_name"], i, j))
                scores.append(s)
        if not cands:
            return []
        return [Span(KINDS[cands[i][0]], spans[cands[i][1]][0], spans[cands[i][2] - 1][1]) for i in best_path(cands, scores, self.moves)]


_FIELDS: dict[str, Field] = {}


def _field_of(key: str, weights: dict[str, float], moves: list[list[float]]) -> Field:
    """The one copy of a field in a worker process, so that its tasks share what it has computed."""
    if key not in _FIELDS:
        _FIELDS.clear()
        _FIELDS[key] = Field(weights, moves)
    return _FIELDS[key]


def fit(sentences: list[tuple[str, list[Span]]], rounds: int = ROUNDS, warm: int = WARM, rate: float = 0.08, decay: float = 0.3, letters: float = 4.0, unlisted: float = 0.4) -> Field:
    """Weights of greatest regularised likelihood, by adaptive gradient steps over all sentences:
    ``warm`` rounds in which each candidate is taken by itself, which cost little, then ``rounds`` over the segmentations.
    ``letters`` holds the many weights of a word's letters closer to nought than ``decay`` the others.

    A share ``unlisted`` of the sentences is read without the lists of given names, so that the other features learn to do without.
    """
    names: dict[str, int] = {}
    rows: list[int] = []
    columns: list[int] = []
    truth: list[float] = []
    data = []
    paths = np.zeros((_START + 1, _START))
    for n, (text, gold) in enumerate(sentences):
        listed = (n * 0.618034) % 1 >= unlisted
        spans, cands = candidates(text, listed)
        if not cands:
            continue
        want, begin, state = set(gold), len(truth), _START
        for c in sorted(cands, key=lambda c: c.first):
            if Span(c.kind, spans[c.first][0], spans[c.last - 1][1]) in want:
                paths[state, _STATE[c.kind]] += 1
                state = _STATE[c.kind]
        for c in cands:
            for f in features_of(c, listed):
                rows.append(len(truth))
                columns.append(names.setdefault(f, len(names)))
            truth.append(float(Span(c.kind, spans[c.first][0], spans[c.last - 1][1]) in want))
        data.append((begin, [(_STATE[c.kind], c.first, c.last) for c in cands]))
    if not truth:
        return Field({}, [[0.0] * _START for _ in range(_START + 1)])
    row, column, yes = np.array(rows), np.array(columns), np.array(truth)
    hold = np.array([letters if ":letters=" in f or ":end=" in f else decay for f in names])
    w, pull, past = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    moves = np.zeros((_START + 1, _START))
    for r in range(warm + rounds):
        scores = np.bincount(row, w[column], len(yes))
        if r < warm:
            likely = 1 / (1 + np.exp(-scores))
        else:
            likely, steps, now = np.empty(len(yes)), np.zeros_like(moves), moves.tolist()
            for begin, cands in data:
                p, s = marginals(cands, scores[begin : begin + len(cands)].tolist(), now)
                likely[begin : begin + len(cands)] = p
                steps += s
            moves = moves + 0.5 * (paths - steps - moves) / np.maximum(paths + steps, 10.0)
        g = np.bincount(column, (yes - likely)[row], len(names)) - hold * w
        pull, past = 0.9 * pull + 0.1 * g, 0.99 * past + 0.01 * g * g
        w += rate * (pull / (1 - 0.9 ** (r + 1))) / (np.sqrt(past / (1 - 0.99 ** (r + 1))) + 1e-3)
    return Field({f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-3}, moves.tolist())


@lru_cache(2)
def default_field(sentences: int = SENTENCES, rounds: int = ROUNDS, seed: int = SEED) -> Field:
    """The field fitted on a bounded number of generated sentences; the same for the same parameters."""
    from .pii_training import examples

    return fit(examples(sentences, seed), rounds)


# ---- texts and tables ----------------------------------------------------------------------------------


def redact(text: str | None, field: Field) -> str | None:
    """The text with a typed placeholder for each mention and nothing else changed. Null stays null."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in field.decode(text):
        out += text[at:a], PLACEHOLDERS[kind]
        at = b
    return "".join([*out, text[at:]])


def without_contacts(text: str) -> str:
    """A payee without what looks like an address, number or place to reach someone; names stay."""
    if not _HINT.search(text):
        return text
    spans, words, _ = _read(text)
    cuts = []
    for c in _shaped(text, words, spans):
        shapes = {f.partition("shape=")[2] for f in c.features if "shape=" in f}
        if shapes - _LOOSE and not shapes & _BARE:
            cuts.append((spans[c.first][0], spans[c.last - 1][1]))
    cuts.sort()
    out, at = [], 0
    for a, b in cuts:
        out.append(text[at:a] if a > at else "")
        at = max(at, b)
    left = "".join([*out, text[at:]])
    return re.sub(r"(?i)\b(?:ssn|itin|nino|dni|passport(?: no)?|tax id(?: \(person\))?|driver lic|steuer-id|tel)\b:?\s*(?:\d{9,11})?\s*", "", left).strip(" <>:")


def _decode_batches(fields: tuple[str, ...], field: Field, shape: str):
    def judge(text: str) -> tuple:
        judged = field.judged
        got = judged.get((shape, text))
        if got is None:
            if len(judged) > 200_000:
                judged.clear()
            got = tuple(sorted({s.kind for s in field.decode(text)})) if shape == "kinds" else redact(text, field)
            if len(text) < 200:
                judged[shape, text] = got
        return got

    def run(batches):
        for batch in batches:
            ids = batch.column("row_id").to_pylist()
            if shape == "kinds":
                rows = [(i, f, k) for f in fields for i, t in zip(ids, batch.column(f).to_pylist(), strict=True) if t for k in judge(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[j] for r in rows], pa.string()) for j in (1, 2))], names=["row_id", "field_name", "pii_kind"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), *(pa.array([judge(t) if t else t for t in batch.column(f).to_pylist()], pa.string()) for f in fields)], names=["row_id", *fields])

    return run


def find(rows: DataFrame, key: str, fields: list[str], field: Field | None = None) -> DataFrame:
    """``row_id, field_name, pii_kind`` for each kind that a field mentions; null and empty fields have none.

    Rows are judged where they are read, without a shuffle; equal short texts of a worker are judged once.
    """
    picked = rows.select(F.col(key).alias("row_id"), *fields)
    return picked.mapInArrow(_decode_batches(tuple(fields), field or default_field(), "kinds"), "row_id bigint, field_name string, pii_kind string")


def redact_fields(rows: DataFrame, key: str, fields: list[str], field: Field | None = None) -> DataFrame:
    """``row_id`` and the fields with placeholders for every mention."""
    picked = rows.select(F.col(key).alias("row_id"), *fields)
    return picked.mapInArrow(_decode_batches(tuple(fields), field or default_field(), "text"), "row_id bigint, " + ", ".join(f"{f} string" for f in fields))
