"""Variant spellings of names of people and organisations, linked by their rewritings.

Every name is read into a core: channel marks, store numbers, places and legal forms go, nicknames and
initials become sets of full names. From the core come all canonical rewritings - word orders run together,
consonant skeletons, one letter left out, first word beside the start of the second, surname beside
given name. Any two cores that ``same_name`` accepts share a rewriting, so the rewritings are exploded and joined on
equality, and whoever shares one is compared exactly. A link's score sums the rarity of what it shares; a rewriting that many
names share is split by a second key rather than dropped. Linked cores are gathered into connected components. Initials and bare surnames come last and
join a person only if a single one fits.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STATES as _STATES
from ..operators.graph import components
from ..session import checkpoint

# ---- fixed values: words of names, channels and places ---------------------------------------------

TITLES = frozenset("MR MRS MS MISS MX DR PROF SIR DAME REV HERR FRAU SR SRA".split())

GIVEN = frozenset(
    """ABIGAIL ADAM AGNES ALBERT ALEXANDER ALICE AMELIA ANDREW ANNA ANTHONY ARTHUR BARBARA BEATRICE BENJAMIN CATHERINE
    CHARLES CHARLOTTE CHRISTOPHER CLARA DANIEL DAVID DEBORAH DOMINIC DOROTHY EDITH EDWARD ELEANOR ELIZABETH EMILY
    ERNEST EUGENE FLORENCE FRANCES FRANCIS FREDERICK GABRIELLE GEORGE GERALD GREGORY HANNAH HAROLD HARRIET HELEN HENRY
    IGNATIUS ISAAC ISABELLA JACOB JAMES JANET JASON JENNIFER JEREMY JOHN JONATHAN JOSEPH JOSEPHINE JUDITH KATARZYNA
    KATHERINE KENNETH LAWRENCE LEONARD LEONORA LINDA LUCY MARGARET MARIA MARTIN MARY MATILDA MATTHEW MICHAEL NANCY
    NATHANIEL NICHOLAS NICOLETTA OLIVER OLIVIA OSWALD PATRICIA PATRICK PAUL PETER PHILIP QUEENIE QUENTIN RACHEL RAYMOND
    REBECCA RICHARD ROBERT ROSE RUTH SAMANTHA SAMUEL SARAH SEBASTIAN SIMON SOPHIA STEPHEN SUSANNAH THEODORA THEODORE
    THOMAS TIMOTHY UMBERTO URSULA VALENTINE VERONICA VICTORIA VINCENT WALTER WILLIAM WINIFRED YOLANDA YUSUF ZACHARY""".split()
)

NICKNAMES: dict[str, tuple[str, ...]] = {
    k: tuple(v.split())
    for k, v in {
        "ABBY": "ABIGAIL", "GAIL": "ABIGAIL", "ALEX": "ALEXANDER", "XANDER": "ALEXANDER", "SASHA": "ALEXANDER", "BARB": "BARBARA", "BABS": "BARBARA", "BARBIE": "BARBARA",
        "BEN": "BENJAMIN", "BENNY": "BENJAMIN", "BENJI": "BENJAMIN", "CATHY": "CATHERINE", "CATE": "CATHERINE", "CAT": "CATHERINE", "KATE": "CATHERINE KATHERINE KATARZYNA", "KATIE": "CATHERINE KATHERINE", "KITTY": "CATHERINE KATHERINE",
        "CHRIS": "CHRISTOPHER", "KIT": "CHRISTOPHER CATHERINE KATARZYNA", "TOPHER": "CHRISTOPHER", "DEB": "DEBORAH", "DEBBIE": "DEBORAH", "DEBS": "DEBORAH", "DOM": "DOMINIC", "NICK": "DOMINIC NICHOLAS",
        "ED": "EDWARD", "EDDIE": "EDWARD", "EDDY": "EDWARD", "TED": "EDWARD THEODORE", "NED": "EDWARD", "ELLIE": "ELEANOR", "NELL": "ELEANOR", "NELLIE": "ELEANOR", "NORA": "ELEANOR LEONORA", "LEO": "LEONORA LEONARD", "LENA": "LEONORA", "LENNIE": "LEONORA LEONARD",
        "FRAN": "FRANCES", "FRANNIE": "FRANCES", "FRANKIE": "FRANCES", "FANNY": "FRANCES", "FRED": "FREDERICK", "FREDDIE": "FREDERICK", "FREDDY": "FREDERICK", "GABBY": "GABRIELLE", "GABI": "GABRIELLE", "GABY": "GABRIELLE", "ELLE": "GABRIELLE",
        "GREG": "GREGORY", "GREGG": "GREGORY", "HATTIE": "HARRIET", "HARRY": "HENRY HAROLD", "HANK": "HENRY", "HAL": "HENRY", "IGGY": "IGNATIUS", "NACHO": "IGNATIUS", "IZZY": "ISABELLA", "BELLA": "ISABELLA", "ISA": "ISABELLA", "BELLE": "ISABELLA",
        "JON": "JONATHAN", "JONNY": "JONATHAN", "JOSIE": "JOSEPHINE", "JO": "JOSEPHINE", "JODIE": "JOSEPHINE", "KASIA": "KATARZYNA", "KASKA": "KATARZYNA", "KEN": "KENNETH", "KENNY": "KENNETH", "LARRY": "LAWRENCE", "LAURIE": "LAWRENCE", "LOZ": "LAWRENCE",
        "MAGGIE": "MARGARET", "MEG": "MARGARET", "PEGGY": "MARGARET", "MARGE": "MARGARET", "GRETA": "MARGARET", "RITA": "MARGARET", "DAISY": "MARGARET", "MATT": "MATTHEW", "MATTY": "MATTHEW", "NATE": "NATHANIEL", "NAT": "NATHANIEL", "NICO": "NICOLETTA", "NICKY": "NICOLETTA", "NIKKI": "NICOLETTA", "ETTA": "NICOLETTA", "COLETTE": "NICOLETTA", "NICOLA": "NICOLETTA",
        "LIV": "OLIVIA", "LIVVY": "OLIVIA", "LIVIA": "OLIVIA", "OZ": "OSWALD", "OZZIE": "OSWALD", "OZZY": "OSWALD", "PAT": "PATRICIA PATRICK", "PATTY": "PATRICIA", "PATSY": "PATRICIA", "TRICIA": "PATRICIA", "TRISH": "PATRICIA", "PETE": "PETER", "QUENT": "QUENTIN", "QUINN": "QUENTIN", "QUEEN": "QUEENIE", "REGINA": "QUEENIE",
        "BECKY": "REBECCA", "BECCA": "REBECCA", "BECKS": "REBECCA", "BOB": "ROBERT", "BOBBY": "ROBERT", "ROB": "ROBERT", "ROBBIE": "ROBERT", "BERT": "ROBERT ALBERT", "SAM": "SAMUEL SAMANTHA", "SAMMY": "SAMUEL", "SUE": "SUSANNAH", "SUSIE": "SUSANNAH", "SUZY": "SUSANNAH", "SUKI": "SUSANNAH", "ZANNA": "SUSANNAH", "SUSAN": "SUSANNAH",
        "THEA": "THEODORA", "DORA": "THEODORA", "TEDDY": "THEODORE EDWARD", "TOM": "THOMAS", "TOMMY": "THOMAS", "BERTO": "UMBERTO", "UMBI": "UMBERTO", "ULLA": "URSULA", "URSA": "URSULA", "URSIE": "URSULA", "VICKY": "VICTORIA", "TORI": "VICTORIA", "VIKKI": "VICTORIA", "VIN": "VINCENT", "VINCE": "VINCENT", "VINNIE": "VINCENT",
        "BILL": "WILLIAM", "BILLY": "WILLIAM", "WILL": "WILLIAM", "LIAM": "WILLIAM", "WILLIE": "WILLIAM", "WINNIE": "WINIFRED", "FREDA": "WINIFRED", "WYN": "WINIFRED", "YOLI": "YOLANDA", "LANDA": "YOLANDA", "YOLA": "YOLANDA", "YUS": "YUSUF", "JOE": "YUSUF JOSEPH", "JOSEF": "YUSUF", "GINNY": "VICTORIA",
    }.items()
}

#: Words of trade and legal form, with the abbreviations that neither start nor thin them out.
TRADES = frozenset(
    """AND AUTO BAKERY BROTHERS CENTER CENTRE CLINIC COFFEE COMPANY CORPORATION DENTAL ENTERPRISES FITNESS GARDEN GROUP GYM
    HARDWARE HOLDINGS INCORPORATED INSURANCE INTERNATIONAL LABORATORIES LABORATORY LIMITED MANAGEMENT MARKET PHARMACY
    PROPERTIES PROPERTY REPAIR RESTAURANT SERVICES SONS SUPPLY TRANSPORT UTILITIES VETERINARY""".split()
)
TRADE_SHORT = frozenset("INC LLC LTD GMBH CORP PLC SA AG BV CO BROS BRS CTR CNTR CL CLN DNTL GRDN HDWE HRDWR INTL LAB LABS MGMT MGT MKT MRKT PHCY PHARM PROP REP RPR REST RSTRNT SPLY SRVC SVC SVCS TRANSP TRNSPT UTIL UTILS VET BKRY BAKRY COF FIT INS INSUR FITNSS N".split())

STATES = frozenset((*_STATES, "DC"))

_CHANNEL = re.compile(r"^(?:POS DEBIT|POS|ACH WEB|ACH|CHECKCARD|DEBIT CARD|RECURRING|RECUR|DD|SQ ?\*|TST ?\*|SP (?=\S)|PP ?\*|PAYPAL ?\*?|EC-KARTE|TPV)\s*")
_PERSON_CHANNEL = re.compile(r"^(?:ZELLE(?: TO| FROM)?|VENMO ?\*?|IOU-APP|P2P XFER|CASH APP ?\*?)\s*")
_TAIL = re.compile(r"(?:\s*[#*]\s*\d+|\s+STORE \d+|, CARD \d+|, \"?WEB\"? ORDER|\s+\d{3,5}(?: .*)?)$")
_VOWELS = re.compile(r"[AEIOU]")


def skeleton(word: str) -> str:
    return _VOWELS.sub("", word)


def within_one(a: str, b: str) -> bool:
    """At most one letter inserted, left out, changed or swapped with its neighbour."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])


def left_out(word: str) -> Iterator[str]:
    """The word, and the word with each letter left out."""
    yield word
    for i in range(len(word)):
        if i == 0 or word[i] != word[i - 1]:
            yield word[:i] + word[i + 1 :]


@lru_cache(200_000)
def given_names(token: str) -> tuple[str, ...]:
    """Full names that a token may stand for; () if it is no given name. One typing error is forgiven from 6 letters on."""
    if token in GIVEN:
        return (token,)
    if token in NICKNAMES:
        return NICKNAMES[token]
    if len(token) >= 6:
        return tuple(sorted(g for g in GIVEN if abs(len(g) - len(token)) < 2 and within_one(token, g)))
    return ()


@lru_cache(200_000)
def is_trade(token: str, last: bool) -> bool:
    if token in TRADES or token in TRADE_SHORT:
        return True
    if last and any(w.startswith(token) for w in TRADES if len(token) >= 3):
        return True
    return len(token) >= 5 and any(len(w) >= 6 and abs(len(w) - len(token)) < 2 and within_one(token, w) for w in TRADES)


@dataclass(frozen=True)
class Core:
    """What a name says once it is stripped. Organisations: readings, each a tuple of words. People: surname and given names."""

    person: bool
    readings: tuple[tuple[str, ...], ...] = ()
    surname: str = ""
    given: tuple[str, ...] = ()
    initial: str = ""

    def key(self) -> str:
        if self.person:
            return f"P|{self.surname}|{','.join(self.given)}|{self.initial}"
        return "O|" + ";".join(map(" ".join, self.readings))

    @property
    def vague(self) -> bool:
        """A person without given name: an initial or a bare surname."""
        return self.person and not self.given

    @staticmethod
    @lru_cache(50_000)
    def of(key: str) -> Core:
        if key[0] == "P":
            _, surname, given, initial = key.split("|")
            return Core(True, (), surname, tuple(filter(None, given.split(","))), initial)
        return Core(False, tuple(tuple(r.split(" ")) for r in key[2:].split(";")))


def read_name(text: str) -> Core | None:
    """Core of a name; None for text without any letters."""
    t = unicodedata.normalize("NFKD", text)
    t = " ".join("".join(c for c in t if not unicodedata.combining(c)).upper().replace("’", "'").split())
    person_channel = False
    while True:
        cut = _CHANNEL.sub("", t, count=1)
        own = _PERSON_CHANNEL.sub("", cut, count=1)
        person_channel |= own != cut
        if own == t:
            break
        t = own
    for _ in range(3):
        t = _TAIL.sub("", t)
    t = t.removesuffix(".COM").replace("INT'L", "INTL")
    comma = "," in t
    left = len(re.findall(r"[A-Z0-9]+", t.partition(",")[0]))
    tokens = re.findall(r"[A-Z]+", re.sub(r"'S\b", "", t))
    if not tokens:
        return None
    title = any(x in TITLES for x in tokens)
    bare = [x for x in tokens if x not in TITLES] or tokens
    core = _person(bare, title, comma, person_channel)
    if core is not None:
        return core
    readings = []
    for words in _places_cut(bare):
        kept = _without_trade(words)
        if comma and len(kept) == 2 and left == 1:
            kept = kept[::-1]
        if kept and tuple(kept) not in readings and (not readings or len(kept) > 1 or len(kept[0]) > 13):
            readings.append(tuple(kept))
    return Core(False, tuple(readings or [tuple(bare)]))


def _person(bare: list[str], title: bool, comma: bool, channel: bool) -> Core | None:
    if len(bare) > 3 or any(len(x) > 2 and x in TRADES for x in bare):
        return None
    if len(bare) == 1:
        return Core(True, (), bare[0]) if title and len(bare[0]) > 3 else None
    initials = [x for x in bare if len(x) == 1]
    words = [x for x in bare if len(x) > 1]
    exact = [x for x in words if x in GIVEN or x in NICKNAMES]
    known = exact or [x for x in words if given_names(x)]
    if len(words) == 2 and len(bare) - 2 == len(initials) and known:
        first = known[-1] if comma and len(known) == 2 else known[0]
        last = next((x for x in words if x is not first), None)
        return Core(True, (), last, given_names(first)) if len(last) > 2 else None
    if len(words) == 1 and initials and len(words[0]) > 3:
        first = initials[-1] if comma or bare[0] not in initials else initials[0]
        return Core(True, (), words[0], (), first)
    if title and len(words) == 2 or channel and len(words) == 2 and not initials:
        last, first = (words[0], words[1]) if comma else (words[1], words[0])
        return Core(True, (), last, (first,))
    return None


def _places_cut(words: list[str]) -> Iterator[list[str]]:
    """The words, and the readings in which a state at the end takes one or two words of a town with it."""
    if len(words) > 2 and words[-1] in STATES:
        yield words[:-2]
        if len(words) > 3:
            yield words[:-3]
    else:
        yield words


def _without_trade(words: list[str]) -> list[str]:
    kept = list(words)
    while len(kept) > 1 and is_trade(kept[-1], len(kept) > 2) or len(kept) > 2 and len(kept[-1]) < 3:
        kept.pop()
    while len(kept) > 1 and is_trade(kept[0], False):
        kept.pop(0)
    return kept


# ---- rewritings and the exact check -----------------------------------------------------------------


def rewritings(core: Core) -> set[str]:
    """Canonical forms of a core, each after the letter of its rule; cores that agree share at least one.

    N, F: surname and given name, F with up to a letter left out of each. O, D, L: all words run together, whole,
    with a letter left out, and as consonants with a letter left out. W: first word and the start of the second
    of so many words. Initials and bare surnames have none; see :func:`entities`.
    """
    out: set[str] = set()
    if core.person:
        s = core.surname
        thin = set(left_out(s)) if len(s) > 4 else {s}
        for g in core.given:
            out.update(f"N{x}|{g}" for x in thin) if len(g) < 4 else out.update(f"F{x}|{y}" for x in thin for y in left_out(g))
        return out
    for words in core.readings:
        run = "".join(words)
        bones = skeleton(run)
        out.add(f"O{run}")
        if len(run) > 4:
            out.update(f"D{x}" for x in left_out(run))
        if len(bones) > 5:
            out.update(f"L{x}" for x in left_out(bones))
        if len(words) > 1:
            n, heads = len(words), set(left_out(words[0])) | _bones_left_out(words[0])
            starts = set(_starts(words[1])) | {f"~{x}" for x in _starts(skeleton(words[1])) if len(skeleton(words[1])) > 2}
            out.update(f"W{n}{h}|{x}" for h in heads for x in starts)
    return out


def _bones_left_out(word: str) -> set[str]:
    bones = skeleton(word)
    return {f"~{x}" for x in left_out(bones)} if len(bones) > 2 else set()


def _starts(word: str) -> set[str]:
    """Two of the first three letters; words one error apart, or one beginning the other, share such a pair. Short words whole."""
    return {word[:2], word[0] + word[2], word[1:3]} if len(word) > 2 else {word}


def _word_close(a: str, b: str, cut: bool) -> bool:
    """Same word: one typing error, thinned out, or (at the end of a name) cut short."""
    if within_one(a, b):
        return min(len(a), len(b)) > 3 or a == b
    bones_a, bones_b = skeleton(a), skeleton(b)
    if len(bones_a) > 2 and len(bones_b) > 2 and (a in (bones_a, a[0] + skeleton(a[1:])) or b in (bones_b, b[0] + skeleton(b[1:]))) and within_one(bones_a, bones_b):
        return True
    short, long = sorted((a, b), key=len)
    return cut and len(short) > 2 and (long.startswith(short) or len(short) > 4 and within_one(short, long[: len(short)]))


def _same_words(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    run_a, run_b = "".join(a), "".join(b)
    if run_a == run_b:
        return True
    if len(a) == len(b) == 2:
        return _word_close(a[0], b[0], False) and _word_close(a[1], b[1], True)
    if len(a) == len(b):
        return len(a) > 2 and all(_word_close(x, y, i == len(a) - 1) for i, (x, y) in enumerate(zip(a, b, strict=True))) or len(a) == 1 and max(len(run_a), len(run_b)) > 5 and within_one(run_a, run_b)
    if min(len(run_a), len(run_b)) < 8 or min(len(a), len(b)) != 1:
        return False
    bones_a, bones_b = skeleton(run_a), skeleton(run_b)
    return within_one(run_a, run_b) or (max(len(bones_a), len(bones_b)) > 6 and within_one(bones_a, bones_b) and abs(len(run_a) - len(run_b)) < 10)


def near_surnames(a: str, b: str) -> bool:
    return a == b or min(len(a), len(b)) > 4 and within_one(a, b)


def same_name(a: Core, b: Core) -> bool:
    """Whether two cores can mean the same; initials and bare surnames agree with every full name they fit."""
    if a.person != b.person:
        return False
    if not a.person:
        return any(_same_words(x, y) for x in a.readings for y in b.readings)
    if not near_surnames(a.surname, b.surname):
        return False
    if a.given and b.given:
        return bool(set(a.given) & set(b.given)) or any(within_one(x, y) and max(len(x), len(y)) > 4 for x in a.given for y in b.given)
    firsts_a, firsts_b = ({g[0] for g in c.given} | set(c.initial) for c in (a, b))
    return not firsts_a or not firsts_b or bool(firsts_a & firsts_b)


# ---- distributed linking ------------------------------------------------------------------------------


def _core_batches(batches):
    for batch in batches:
        names = batch.column("name").to_pylist()
        cores = [None if n is None or (c := read_name(n)) is None else c.key() for n in names]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(cores, pa.string())], names=["name", "core"])


def cores(names: DataFrame) -> DataFrame:
    """name, core for the distinct spellings in ``names(name)``; core is null where a name has no letters."""
    return names.select("name").where(F.col("name").isNotNull()).distinct().mapInArrow(_core_batches, "name string, core string")


def _form_batches(batches):
    for batch in batches:
        forms: list[str] = []
        owners: list[str] = []
        groups = batch.column("grp").to_pylist()
        for key, grp in zip(batch.column("core").to_pylist(), groups, strict=True):
            got = [f"{x}\x1f{grp}" for x in rewritings(Core.of(key))] if grp else rewritings(Core.of(key))
            forms += got
            owners += [key] * len(got)
        for i in range(0, len(forms), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(forms[i : i + 50_000], pa.string()), pa.array(owners[i : i + 50_000], pa.string())], names=["form", "core"])


def link_group(members: Iterable[str]) -> Iterator[tuple[str, str]]:
    """Links among cores, so that all that agree, in one step or several, are connected.

    Members stream by; each is compared with members of every cluster found so far, whether these came first or not,
    and joins all clusters in which one agrees.
    """
    clusters: list[list[tuple[str, Core]]] = []
    for key in members:
        core = Core.of(key)
        met = [(c, k) for c in clusters if (k := next((k for k, x in c if same_name(x, core)), None)) is not None]
        fits = [c for c, _ in met]
        for _, k in met:
            yield k, key
        if len(fits) == 1:
            fits[0].append((key, core))
        else:
            clusters = [c for c in clusters if not any(c is f for f in fits)] + [[x for c in fits for x in c] + [(key, core)]]


#: A rewriting shared by more cores than this is not compared in one place: see :func:`_finer_batches`.
HOT = 256
_LINK = pa.schema([("a", pa.string()), ("b", pa.string()), ("grp", pa.string()), ("rarity", pa.float64()), ("form", pa.string())])
_LINK_DDL = "a string, b string, grp string, rarity double, form string"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(_LINK.types)], schema=_LINK)


def _shared(batches) -> Iterator[tuple[list[str], list[str]]]:
    """(forms, cores) of the rows of sorted (form, core) whose form stands there more than once; the others never reach the interpreter one by one."""
    held, given = None, False
    for batch in batches:
        rows = pa.RecordBatch.from_arrays([batch.column("form"), batch.column("core")], names=["form", "core"])
        if held is not None:
            rows = pa.concat_batches([held, rows])
        n = rows.num_rows
        if n == 0:
            continue
        keep = np.zeros(n, bool)
        if n > 1:
            forms = rows.column("form")
            same = pc.equal(forms.slice(1), forms.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            keep[1:] |= same
            keep[:-1] |= same
        out = keep.copy()
        out[0] &= not (held is not None and given)  # it came out with the batch before
        held, given = rows.slice(n - 1, 1), bool(keep[-1] or n == 1 and given)
        kept = rows.filter(pa.array(out))
        if kept.num_rows:
            yield kept.column("form").to_pylist(), kept.column("core").to_pylist()


def _link_batches(most: int):
    """Sorted (form, core) -> links of the cores that share a form, each with the form's rarity, 2 over the number of cores that share it.

    Of a form of :func:`rewritings` by two words that more than ``most`` cores share the members come out unlinked, with ``form`` set, as they stream by.
    """

    def flush(form, members):
        if len(members) < 2:
            return []
        grp = form.partition("\x1f")[2]
        return [(a, b, grp, 2.0 / len(members), None) for a, b in link_group(members)]

    def run(batches):
        current, members, hot = None, [], False
        for forms, cores_of in _shared(batches):
            found: list[tuple] = []
            for form, core in zip(forms, cores_of, strict=True):
                if form != current:
                    if current is not None and not hot:
                        found += flush(current, members)
                    current, members, hot = form, [], False
                members.append(core)
                if hot or form[0] == "W" and len(members) > most:
                    found += [(c, None, form.partition("\x1f")[2], None, form) for c in members]
                    hot, members = True, []
                if len(found) > 20_000:
                    yield _rows(found)
                    found = []
            if found:
                yield _rows(found)
        if current is not None and not hot and (found := flush(current, members)):
            yield _rows(found)

    return run


def _second_word(words: tuple[str, ...]) -> Iterator[tuple[str, bool]]:
    """(key, whether the word stands whole) of a second word: words that are close share a key under which one at least stands whole."""
    w = words[1]
    yield from ((f"1{x}", True) for x in left_out(w))
    if len(bones := skeleton(w)) > 2:
        yield from ((f"2{x}", True) for x in left_out(bones))
    yield f"3{w}", True
    yield from ((f"3{w[:k]}", False) for k in range(3, len(w)))
    if len(w) > 4:
        yield from ((f"4{x}", True) for x in left_out(w))
        yield from ((f"4{x}", False) for k in range(5, len(w)) for x in set(left_out(w[:k])))


def _finer_batches(batches):
    """Members of hot forms by first words -> (form, core, part): the form together with each key of the second word; wholes before parts."""
    for batch in batches:
        out: set[tuple[str, str, int]] = set()
        for form, key in zip(batch.column("form").to_pylist(), batch.column("a").to_pylist(), strict=True):
            n = int(re.match(r"W(\d+)", form)[1])
            for words in Core.of(key).readings:
                if len(words) == n:
                    out.update((f"{form}\x1e{k}", key, 0 if whole else 1) for k, whole in _second_word(words))
        rows = sorted(out)
        for i in range(0, len(rows), 50_000):
            part = rows[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.string()), pa.array([r[2] for r in part], pa.int32())], names=["form", "core", "part"])


def _finer_link_batches(batches):
    """Sorted (form, part, core) -> links: wholes among themselves, each part with the wholes only, as it streams by."""
    current, wholes, linked = None, [], False

    def flush(form, members):
        grp = form.partition("\x1f")[2].partition("\x1e")[0]
        return [(a, b, grp, 2.0 / len(members), None) for a, b in link_group(members)] if len(members) > 1 else []

    for batch in batches:
        found: list[tuple] = []
        for form, part, key in zip(*(batch.column(c).to_pylist() for c in ("form", "part", "core")), strict=True):
            if form != current:
                if current is not None and not linked:
                    found += flush(current, wholes)
                current, wholes, linked = form, [], False
            if part == 0:
                wholes.append(key)
                continue
            if not linked:
                found += flush(current, wholes)
                linked = True
            core, grp = Core.of(key), form.partition("\x1f")[2].partition("\x1e")[0]
            found += [(w, key, grp, 2.0 / (len(wholes) + 1), None) for w in wholes if w != key and same_name(Core.of(w), core)]
            if len(found) > 20_000:
                yield _rows(found)
                found = []
        if found:
            yield _rows(found)
    if current is not None and not linked and (found := flush(current, wholes)):
        yield _rows(found)


def _node(core: str = "core") -> F.Column:
    return F.when(F.col("grp") == "", F.col(core)).otherwise(F.concat_ws("\x1f", "grp", core))


def links(keys: DataFrame, hot_from: int = HOT) -> DataFrame:
    """a, b, score: links between the nodes of the distinct ``keys(core, grp)``, through equal rewritings; initials and bare surnames have none.

    Whoever shares a rewriting is compared exactly. ``score`` sums the rarity of the rewritings that gave the link: 1 for each that
    only the two share. A rewriting by two words that many share is joined once more together with the keys of the second word, so no group
    grows with the number of names that begin alike.
    """
    forms = keys.select("core", "grp").mapInArrow(_form_batches, "form string, core string")
    met = checkpoint(forms.repartition(F.col("form")).sortWithinPartitions("form", "core").mapInArrow(_link_batches(hot_from), _LINK_DDL))
    found, hot = met.where(F.col("form").isNull()), met.where(F.col("form").isNotNull())
    if not hot.isEmpty():
        finer = hot.select("form", "a").repartition(F.xxhash64("form", "a")).mapInArrow(_finer_batches, "form string, core string, part int").distinct()
        found = found.unionByName(finer.repartition(F.col("form")).sortWithinPartitions("form", "part", "core").mapInArrow(_finer_link_batches, _LINK_DDL))
    return found.select(_node("a").alias("a"), _node("b").alias("b"), "rarity").groupBy("a", "b").agg(F.sum("rarity").alias("score"))


def _near_batches(batches):
    for batch in batches:
        pairs = zip(batch.column("mine").to_pylist(), batch.column("theirs").to_pylist(), strict=True)
        yield batch.filter(pa.array([near_surnames(a, b) for a, b in pairs], pa.bool_()))


def _thin(rows: DataFrame, surname: str) -> DataFrame:
    """The rows once for each spelling ``x`` of the surname with up to a letter left out."""
    s = F.col(surname)
    cut = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.left(s, i - 1), F.substring(s, i + 1, F.length(s))))
    return rows.withColumn("x", F.explode(F.when(F.length(s) > 4, F.array_distinct(F.concat(F.array(s), cut))).otherwise(F.array(s))))


def _settle(vague: DataFrame, people: DataFrame) -> DataFrame:
    """The rows of ``vague(grp, node, surname, initial)`` with ``label``.

    A core takes the label of the person it fits, if it is one. The others are linked with those of like surname and the same
    initial, and their component takes the label of a person if all its members together fit one, else its own.
    """
    mine = checkpoint(_thin(vague.withColumnRenamed("surname", "mine"), "mine"))
    theirs = _thin(people.withColumnRenamed("surname", "theirs"), "theirs")
    met = mine.join(theirs, ["grp", "x"]).where((F.col("initial") == "") | (F.col("initial") == F.col("first"))).select("node", "mine", "theirs", "lo", "hi")
    fits = met.mapInArrow(_near_batches, met.schema).groupBy("node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    known = checkpoint(vague.join(fits, "node", "left"))
    one = F.coalesce(F.col("lo") == F.col("hi"), F.lit(False))
    sole, rest = known.where(one), known.where(~one)
    if rest.isEmpty():
        return sole.select("grp", "node", "surname", "initial", F.col("lo").alias("label"))
    a = mine.join(rest.select("node"), "node", "left_semi")
    b = mine.join(known.select("node", "lo", one.alias("one")), "node").select("grp", "x", "initial", F.col("node").alias("b"), F.col("mine").alias("theirs"), "lo", "one")
    pairs = a.join(b, ["grp", "x", "initial"]).where(F.col("node") != F.col("b")).select("node", "b", "mine", "theirs", "lo", "one")
    pairs = checkpoint(pairs.mapInArrow(_near_batches, pairs.schema))
    comp = components(pairs.where(~F.col("one")).select(F.col("node").alias("a"), "b")).select("node", F.col("label").alias("own"))
    owned = rest.join(comp, "node", "left").withColumn("own", F.coalesce("own", "node"))
    beside = pairs.where("one").groupBy("node").agg(F.min("lo").alias("near_lo"), F.max("lo").alias("near_hi"))
    bounds = owned.join(beside, "node", "left").groupBy("own").agg(F.min(F.least("lo", "near_lo")).alias("all_lo"), F.max(F.greatest("hi", "near_hi")).alias("all_hi"))
    done = owned.join(bounds, "own").withColumn("label", F.when(F.col("all_lo") == F.col("all_hi"), F.col("all_lo")).otherwise(F.col("own")))
    return sole.withColumn("label", F.col("lo")).select("grp", "node", "surname", "initial", "label").unionByName(done.select("grp", "node", "surname", "initial", "label"))


def entities(core_keys: DataFrame) -> DataFrame:
    """node, label for the distinct cores in ``core_keys(core)``: equal labels mean the same.

    With a column ``grp``, cores of different groups stay apart and a node is ``grp``, a unit separator and the core. :func:`group_entities`
    gives the same for a few cores in memory.
    """
    grp = F.col("grp") if "grp" in core_keys.columns else F.lit("")
    keys = checkpoint(core_keys.select("core", grp.alias("grp")).distinct().withColumn("node", _node()))
    vague = F.col("core").rlike(r"^P\|[^|]*\|\|")
    sure = components(links(keys.where(~vague)).select("a", "b"))
    found = checkpoint(keys.where(~vague).join(sure, "node", "left").select("core", "grp", "node", F.coalesce("label", "node").alias("label")))
    part = lambda i: F.split("core", r"\|")[i]
    unsure = checkpoint(keys.where(vague).select("grp", "node", part(1).alias("surname"), part(3).alias("initial")))
    if unsure.isEmpty():
        return found.select("node", "label")
    bounds = (F.min("label").alias("lo"), F.max("label").alias("hi"))
    firsts = found.where(F.col("core").startswith("P|")).select("grp", part(1).alias("surname"), F.explode(F.split(part(2), ",")).alias("given"), "label")
    people = checkpoint(firsts.groupBy("grp", "surname", F.left("given", F.lit(1)).alias("first")).agg(*bounds))
    initials = checkpoint(_settle(unsure.where("initial != ''"), people))
    people = people.unionByName(initials.groupBy("grp", "surname", F.col("initial").alias("first")).agg(*bounds))
    bare = _settle(unsure.where("initial = ''"), people)
    return found.select("node", "label").unionByName(initials.select("node", "label")).unionByName(bare.select("node", "label"))


def group_entities(keys: Iterable[str]) -> dict[str, str]:
    """Label of each of a few distinct cores; the rule of :func:`entities`, every pair compared."""
    cores_of = {k: Core.of(k) for k in sorted(keys)}
    label = _least(cores_of, link_group(k for k, c in cores_of.items() if not c.vague))
    people = [k for k, c in cores_of.items() if c.person and not c.vague]
    for bare in (False, True):
        tier = [k for k, c in cores_of.items() if c.vague and (not c.initial) == bare]
        fits = {k: {label[p] for p in people if same_name(cores_of[p], cores_of[k])} for k in tier}
        rest = [k for k in tier if len(fits[k]) != 1]
        like = {k: [j for j in tier if j != k and cores_of[j].initial == cores_of[k].initial and near_surnames(cores_of[j].surname, cores_of[k].surname)] for k in rest}
        own = _least(rest, ((k, j) for k in rest for j in like[k] if len(fits[j]) != 1))
        whole: dict[str, set[str]] = {}
        for k in rest:
            whole.setdefault(own[k], set()).update(fits[k], *(fits[j] for j in like[k] if len(fits[j]) == 1))
        label |= {k: min(fits[k]) for k in tier if len(fits[k]) == 1}
        label |= {k: min(whole[own[k]]) if len(whole[own[k]]) == 1 else own[k] for k in rest}
        people += tier
    return label


def _least(nodes: Iterable[str], pairs: Iterable[tuple[str, str]]) -> dict[str, str]:
    """The least node of each one's component."""
    root = {k: k for k in nodes}

    def top(k: str) -> str:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {k: top(k) for k in root}


def link_names(names: DataFrame) -> DataFrame:
    """name, core, entity for every distinct non-null spelling in ``names(name)``.

    Spellings with one ``entity`` mean the same person or organisation. A name without letters is its
    own entity, as is one that no other agrees with. Extra columns are left behind; repeated rows count once.
    """
    read = checkpoint(cores(names))
    keys = read.where(F.col("core").isNotNull()).select("core").distinct()
    found = entities(keys)
    return read.join(found, F.col("core") == F.col("node"), "left").select("name", "core", F.coalesce("label", "core", F.concat(F.lit("?|"), F.col("name"))).alias("entity"))
