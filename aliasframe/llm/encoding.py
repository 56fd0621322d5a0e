"""Text decoded with the wrong character encoding: the shortest description tells the original.

Candidates for a text are all chains of "write the characters in one code page, read the bytes in another",
up to three steps long. Every candidate is compressed with a zstandard dictionary per language, trained here on
phrases made of the language's words; its description length is the compressed size, an escape for each character that is foreign to the
language, and the cost of the chain. One more candidate says that letters were lost: the text without its foreign runs, at a cost for each run. The
shortest description wins. If that is the text as it stands, it is left unchanged; if letters were lost, it is reported without a repair.
"""

from __future__ import annotations

import random
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a chain's step (reading UTF-8 as a one-byte page, a page as another, losing an invisible mark), of a
#: letter of a neighbouring language, of any other foreign character, and of a mark inside a word. Later pages cost a little more.
STEP_UTF8, STEP_PAGE, STEP_LOST, NEAR, ESCAPE, MIXED = 10.0, 14.0, 4.0, 3.0, 14.0, 14.0
#: Bits of a run of letters that was lost, of a sign that stands by itself, as signs do, and of two scripts meeting inside a word.
LOST, ALONE, SCRIPTS = 40.0, 2.0, 30.0
#: Phrases a dictionary is trained on, its size in bytes, and the seed.
PHRASES, DICTIONARY, SEED = 4000, 4096, 5
MOST_STEPS = 3

#: The pages text is wrongly read in; the second part is read in place of the first.
PAGES = ("cp1252", "latin-1", "cp1251", "cp437", "mac_roman", "cp850", "cp1250")
PAGE_FOR_PAGE = (("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "cp1250"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"))

#: Letters of each language beyond a-z, and a few words of its shop and street names, to train on.
LANGUAGES: dict[str, tuple[str, str]] = {
    "en": ("£€", "the and for with payment card purchase order store market coffee bakery may rent groceries invoice refund pending it’s kid’s tonight’s dinner “gift” – — … thanks café"),
    "de": ("äöüß", "Bäckerei Straßenverkauf Gärtnerei Würstlstand Müller Mühle Fahrradladen Straße für über Grüße Köln München Größe Kassenbon Tisch GmbH EC-Karte"),
    "fr": ("àâçéèêëîïôùûüœ", "Pâtisserie Boulangerie Crêperie Brûlerie Hôtel Château Café Père et Fils cotisation à l’année crème été garçon déjà théâtre île Œuvre Lumière"),
    "es": ("áéíóúñü¡¿ºª", "Peluquería Mercería Librería Mesón Piñata Única Clínica Jardín Ñandú Añejo Cangrejo Taberna España mañana niño corazón"),
    "pt": ("áâãàçéêíóôõúºª", "Farmácia Açougue São Pão de Açúcar Quente Coração Estação Água Viva Irmã Avó e Avô Doces Maçã Fábrica Fundação não"),
    "it": ("àèéìòù", "Caffè Città Perché più così Gelateria Università Macelleria Libertà"),
    "nordic": ("åäöæø", "Køkken Blåbær Følger Jørgensen Købmand Smörgås Kött Tårn Ål Ærø Sønder"),
    "pl": ("ąćęłńóśźż", "Łaźnia Żabka Łódka Kraków Święta Spółka Piękna Źródło Główna Księgarnia"),
    "cs": ("áčďéěíňóřšťúůýž", "Čajovna Pekařství Žižkov Náměstí Krč Dům Kůň Lékárna Květinářství"),
    "hu": ("áéíóöőúüű", "Kávéház Őrség Fűszer Cukrászda Gyógyszertár Könyvesbolt"),
    "ru": ("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "Кофейня Рябина Аптека Магазин Пекарня Книги Хлеб Ресторан Цветы Москва улица"),
    "el": ("αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋ", "Καφές Ελιά Φούρνος Ταβέρνα Φαρμακείο Βιβλιοπωλείο Αθήνα Θάλασσα"),
}
_COMMON = frozenset("’‘“”–—…€£")
_CONTROL = re.compile("[\x80-\x9f]")
_MARK_INSIDE = re.compile("(?<=[^\\W\\d_])[‘“”„‚‹›–—…†‡•·°¨´¯¸ˆ˜º¬«»](?=[^\\W\\d_])")
_HOLE = re.compile("Ã(?: |(?=[A-Za-z]))")
#: Runs that may stand for lost letters: controls, replacement marks, signs that touch a letter, and lead bytes of UTF-8 with what follows them.
_RUN = re.compile("[\x80-\x9f\ufffd]+|(?<=[^\\W\\d_])[^\\w\\s\x00-\x7f]+|[^\\w\\s\x00-\x7f]+(?=[^\\W\\d_])|(?:[ÃÂÄÅâГРСÎÐÑ├┬┼╨╤√][^\x00-\x7f]|(?<=[a-zà-ÿ])Ã)[^\x00-\x7fa-zA-Z]*|[\u0370-\u03ff\u2200-\u23ff]")


@lru_cache(1)
def dictionaries() -> dict[str, tuple[zstandard.ZstdCompressor, frozenset[str], int]]:
    """Per language: a compressor with a trained dictionary, its letters, and an empty frame's size."""
    out = {}
    for name, (letters, words) in LANGUAGES.items():
        r, held = random.Random(SEED), words.split()
        phrases = [" ".join(r.choice(held) for _ in range(r.randint(1, 5))) for _ in range(PHRASES)]
        phrases = [r.choice((p, p.upper(), p.lower())).encode() for p in phrases]
        trained = zstandard.train_dictionary(DICTIONARY, phrases, level=5)
        code = zstandard.ZstdCompressor(level=5, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False)
        out[name] = code, frozenset(letters) | frozenset(letters.upper()) | _COMMON, len(code.compress(b""))
    return out


@lru_cache(100_000)
def _length(text: str) -> tuple[float, str]:
    """Description length of a text in bits, and the language that gives it."""
    known, foreign = _latin(), [(c, text[max(i - 1, 0) : i].isalpha() or text[i + 1 : i + 2].isalpha()) for i, c in enumerate(text) if ord(c) > 127]
    data, best = text.encode("utf-8", "surrogatepass"), (float("inf"), "")
    for name, (code, letters, empty) in dictionaries().items():
        cost = sum(0.0 if c in letters else NEAR if c in known else _foreign(c, touches) for c, touches in foreign)
        if cost < best[0]:  # the compressed size only adds to it
            best = min(best, (8.0 * (len(code.compress(data)) - empty) + cost, name))
    scripts = [0 if c < "\u0370" else 1 if c < "\u0400" else 2 if c < "\u0530" else 3 if c.isalpha() else -1 for c in text] if foreign else []
    mixed = sum(x != y and -1 not in (x, y) and a.isalpha() and b.isalpha() for x, y, a, b in zip(scripts, scripts[1:], text, text[1:], strict=False)) if any(scripts) else 0
    marks = len(_MARK_INSIDE.findall(text))
    return best[0] + SCRIPTS * mixed + MIXED * marks, best[1]


@lru_cache(1)
def _latin() -> frozenset[str]:
    """Letters that any of the languages in Latin script writes."""
    return frozenset(c for _, letters, _ in dictionaries().values() for c in letters if c.isalpha() and c < "\u0250")


def _foreign(c: str, touches: bool) -> float:
    """Bits of a character that no language here writes; a sign beside a letter costs more than one by itself."""
    return ALONE if not touches and unicodedata.category(c)[0] == "S" and c != "\ufffd" else ESCAPE + _oddity(c)


def _oddity(c: str) -> float:
    """Further bits for characters that hardly stand in names: controls, boxes, signs."""
    kind = unicodedata.category(c)
    return 20.0 if kind in ("Cc", "Cf", "Co", "Cn") or c == "�" else 10.0 if kind[0] in "SZ" or kind in ("No", "Lo") else 4.0 if kind[0] == "P" else 0.0


def _back(text: str, page: str) -> bytes | None:
    """The bytes a text was read from, if it was read in ``page``; marks the page lacks keep their number."""
    out = bytearray()
    for c in text:
        try:
            out += c.encode(page)
        except UnicodeEncodeError:
            if page == "cp1252" and 0x80 <= ord(c) <= 0x9F:
                out.append(ord(c))
            else:
                return None
    return bytes(out)


def candidates(text: str) -> dict[str, tuple[float, tuple[str, ...]]]:
    """Text -> (cost, chain) of everything a chain of misreadings may have come from, the text itself included."""
    found: dict[str, tuple[float, tuple[str, ...]]] = {text: (0.0, ())}
    front = [text]
    plain = not _MARK_INSIDE.search(text) and all(c < "\x80" or c in _latin() or c in _COMMON for c in text)
    if _HOLE.search(text):  # a no-break space came through as a space, a soft hyphen not at all
        whole = _HOLE.sub(lambda m: "Ã\xa0" if m[0][-1] == " " else "Ã\xad" + m[0][1:], text)
        found[whole] = (STEP_LOST, ("invisible mark lost",))
        front.append(whole)
    for step in range(MOST_STEPS):
        nxt = []
        for t in front:
            cost, chain = found[t]
            for late, page in enumerate(PAGES):
                raw = _back(t, page)
                if raw is None or raw.isascii():
                    continue
                try:
                    got = raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                now = (cost + STEP_UTF8 + late / 4, (*chain, f"utf-8 read as {page}"))
                if got not in found or now < found[got]:
                    found[got] = now
                    nxt.append(got)
            if step == 0 and not plain:  # a letter of any language costs less than such a chain
                for late, (written, read) in enumerate(PAGE_FOR_PAGE):
                    raw = _back(t, read)
                    if raw is None:
                        continue
                    try:
                        got = raw.decode(written)
                    except UnicodeDecodeError:
                        continue
                    now = (cost + STEP_PAGE + 4 * late, (*chain, f"{written} read as {read}"))
                    if got not in found:
                        found[got] = now
        front = nxt
    return found


def _without_lost(text: str) -> tuple[str, float]:
    """The text without the runs that may stand for lost letters, and what leaving them out costs."""
    runs = _RUN.findall(text)
    return _RUN.sub("", text), LOST * len(runs) if runs else float("inf")


@lru_cache(100_000)
def repair(text: str) -> tuple[str | None, bool, str]:
    """(restored or None, damaged, chain) of a text.

    Undamaged: (None, False, ""). Damaged and restored: the original and its chain. Damaged beyond repair:
    (None, True, ""). ASCII text, empty text and null are never damaged.
    """
    if not text or text.isascii():
        return None, False, ""
    best = min((_length(t)[0] + cost, len(chain), t, chain) for t, (cost, chain) in candidates(text).items())
    restored, chain = best[2], best[3]
    if chain:
        return (None, True, "") if "\ufffd" in restored or _CONTROL.search(restored) else (restored, True, "; ".join(reversed(chain)))
    plain, cost = _without_lost(text)
    return None, cost + _length(plain)[0] < best[0], ""


_OUT = "text string, restored string, damaged boolean, chain string"


def _repair_batches(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        got = [repair(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(texts, pa.string()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.bool_()), pa.array([g[2] or None for g in got], pa.string())],
            names=["text", "restored", "damaged", "chain"],
        )


def repair_texts(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """``key`` columns, text, restored, chain of the damaged rows of a column.

    Texts of ASCII characters only can't be damaged and leave the plan in the scan. Each distinct text is
    judged once. ``restored`` and ``chain`` are null where the original cannot be recovered.
    """
    suspects = rows.select(*key, F.col(text).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7F]"))
    judged = suspects.select("text").distinct().mapInArrow(_repair_batches, _OUT).where("damaged")
    return suspects.join(judged, "text").select(*key, "text", "restored", "chain")
