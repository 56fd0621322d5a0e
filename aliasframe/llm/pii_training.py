"""Labelled sentences for the field of :mod:`pii`, made from syllables, name lists and words of the public vocabulary.

Words around a mention are drawn at random from the vocabulary's small-written words, so that no frame of a real
memo is learned by heart. Unlisted names are drawn from words the vocabulary knows with a capital only and from syllables.
"""

from __future__ import annotations

import random
import re

from .encoding import LANGUAGES
from .names import GIVEN, NICKNAMES, STATES, TRADES
from .pii import _CUE_OF, Span, vocabulary, written_words

_ONSET = "b c d f g h j k l m n p qu r s t v w x y z dr br th pr gr st sh ch kr sv sz mc".split()
_RIME = "a e i o u al en or im un as ar el ov ul ez ia an on in er".split()
#: Streets, by their words in several languages.
_STREETS = "st street ave avenue rd road blvd boulevard lane ln court ct way dr drive terrace ter place pl square sq close crescent parkway pkwy hill row".split()
#: Ways to lead up to a person that are cues by themselves.
_LEADS = ("zelle to", "zelle from", "zelle", "venmo *", "venmo", "cash app *", "attn", "attn:", "iou-app", "p2p xfer", "payee", "recipient", "name:", "tenant")
_CHANNELS = ("pos debit", "ach web", "sq *", "tst* ", "sp ", "paypal *", "paypal ", "recur", "dd", "checkcard", "pos", "debit card", "ec-karte")

# ---- fixed values: names of many languages to learn letters from; none of them is looked up when a text is read ----
GIVEN_ELSEWHERE = """ABDUL ADITYA AGNIESZKA AHMED AISHA AKIKO ALEJANDRO ALESSANDRO AMANDA AMARA AMIT ANDREI ANITA ANJALI ANTONIO ARJUN ASHLEY ASTRID AYESHA
    BEATRIZ BOGDAN BRANDON BRENDA BRUNO CAMILA CARMEN CAROLINE CECILIA CHIARA CHINEDU CLAUDIA CODY CRISTINA DEEPAK DIEGO DMITRI DUNCAN ELENA EMEKA ENRIQUE ERIK
    ESTEBAN FABIO FELIX FERNANDO FILIPPO FREYA GIOVANNI GIULIA GRACE GUSTAV HAMZA HANS HASSAN HEATHER HIROSHI HUGO IBRAHIM INGRID IRINA ISABEL IVAN JAMAL JAVIER
    JIAN JORGE JUAN JULIA JUSTIN KARIM KARL KAYLA KEIKO KHADIJA KWAME LAILA LARS LAURA LEILA LI LUCAS LUIS MAGNUS MANUEL MARCO MARCUS MATEO MEGAN MEI MIGUEL MIN
    MOHAMED MONICA NADIA NATALIA NEHA NICOLE NIKOLAI NOAH OLGA OMAR PABLO PAOLA PEDRO PIETRO RAFAEL RAJ RAMON RASHID RICARDO ROHAN SAKURA SANDRA SANJAY SANTIAGO
    SERGEI SHAUN SIMONE STEFAN SUNITA SVEN TAMARA TAKESHI TATIANA TIFFANY TOMASZ TRAVIS VALERIA VIKRAM VLADIMIR XIN YASMIN YOUSSEF YUKI ZAHRA ZOE""".split()
SURNAMES = """ABBASI ADAMS ADEYEMI AGARWAL ALLEN ALVAREZ ANDERSEN BAKER BANERJEE BAUER BECKER BENNETT BIANCHI BLANC BROWN CAMPBELL CARTER CASTRO CHAN CHO CLARK COHEN COOPER
    COSTA COX CRUZ DAVIES DELGADO DIAZ DUBOIS DUNN EDWARDS ESPOSITO EVANS FERNANDES FERRARI FISCHER FONSECA FOX GARCIA GOMEZ GONZALEZ GREEN GUPTA GUTIERREZ HALL
    HANSEN HARRIS HERNANDEZ HILL HOFFMANN HUANG HUGHES HUSSEIN IVANOV IYER JACKSON JANSSEN JENSEN JOHANSSON JONES JOSHI KAMARA KANG KAPOOR KELLY KHAN KIM KING
    KOWALSKI KUMAR LAM LARSEN LEE LEWIS LIM LIN LINDBERG LOPEZ MARINO MARTINEZ MEHTA MENSAH MEYER MILLER MOORE MORALES MOREAU MULLER NAKAMURA NIELSEN NOVAK
    OKAFOR OLSEN ORTIZ OWENS PARK PATEL PEREIRA PETROV PHAM PHILLIPS POPESCU PRICE RAMIREZ REDDY REYES RICCI RIVERA ROBINSON ROMANO ROSS RUIZ SANTOS SATO SCHMIDT
    SCHNEIDER SHAH SILVA SINGH SMITH SOKOLOV SUZUKI TANAKA TAYLOR TORRES TRAN TURNER VARGAS VOLKOV WAGNER WALKER WANG WARD WEBER WHITE WILSON WONG WRIGHT YAMAMOTO
    YANG YILMAZ YOUNG ZHOU""".split()


def examples(count: int, seed: int) -> list[tuple[str, list[Span]]]:
    """``count`` texts with the spans of their mentions; the same for the same parameters."""
    r = random.Random(seed)
    given, nick, trades = sorted(GIVEN), sorted(NICKNAMES), sorted(TRADES - {"AND"})
    small, large = vocabulary()
    listed = {w.lower() for w in (*given, *nick)}
    plain = sorted(w for w in small if len(w) > 2 and w not in listed and w not in _CUE_OF)
    frequent = [w for w in plain if small[w] != "C"]
    proper = sorted(w for w in large if 3 <= len(w) <= 10 and w not in small and w not in listed)
    rare = sorted(w for w in written_words() if 4 <= len(w) <= 10 and w not in small and w not in large and w not in listed and w.upper() not in GIVEN_ELSEWHERE and w.upper() not in SURNAMES)
    foreign = sorted({w for _, text in LANGUAGES.values() for w in text.split() if w[0].isalpha()})
    known_proper = [w for w in proper if w.upper() in GIVEN_ELSEWHERE] or GIVEN_ELSEWHERE

    syllables = lambda k: "".join(r.choice(_ONSET) + r.choice(_RIME) for _ in range(k)).capitalize()
    digits = lambda pattern: re.sub("9", lambda _: r.choice("0123456789"), pattern)
    letter = lambda: r.choice("ABCDEFGHJKLMNPRSTVWYZ")
    case = lambda s: r.choice((s, s, s.upper(), s.lower()))
    word = lambda: r.choice(frequent if (x := r.random()) < 0.5 else plain if x < 0.75 else rare)
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    number = lambda: digits(r.choice(("9", "99", "999", "9999", "99999", "999999", "99.99", "9.9999", "999.99")))

    def accented(w: str) -> str:
        """The word with one vowel marked, or the same as text comes out of a wrong decoding."""
        at = [i for i, c in enumerate(w) if c in "aeiou"]
        if not at:
            return w
        i = r.choice(at)
        out = w[:i] + r.choice({"a": "áàâäãå", "e": "éèêë", "i": "íìî", "o": "óòôöõø", "u": "úùûü"}[w[i]]) + w[i + 1 :]
        if r.random() < 0.4:
            out = out.encode().decode(r.choice(("cp1252", "cp437", "cp1251", "latin-1")), "replace")
        return out

    def abroad() -> str:
        """A shop or a note in another language."""
        a, b = r.choice(foreign), accented(syllables(r.randint(2, 3)))
        return r.choice((f"{a} {b}", f"{a} {r.choice(('de', 'le', 'à', 'la', 'du'))} {b}", f"{a} {r.choice(foreign)}", f"{r.choice(foreign)} {r.choice(('de', 'e', 'à', 'und', 'für'))} {r.choice(foreign)}", f"{r.choice(foreign)} e {r.choice(foreign)} {r.choice(foreign)}", f"{b} {r.choice(('GmbH', 'Tisch 3', 'ref 82', a))}", f"EC-Karte {a} {b}", f"{word()} {a} {word()}"))

    def first(sure: bool) -> str:
        x = r.random()
        if x < 0.3:
            return r.choice(given)
        if x < 0.42:
            return r.choice(nick)
        if x < 0.47:
            return _slip(r, r.choice(given))
        if x < 0.8:
            return r.choice(GIVEN_ELSEWHERE)
        return (r.choice(proper) if r.random() < 0.4 else syllables(r.randint(1, 3))) if sure else r.choice(known_proper)

    def last() -> str:
        x = r.random()
        if x < 0.45:
            out = syllables(r.randint(2, 5))
        elif x < 0.65:
            out = r.choice(SURNAMES).capitalize()
        elif x < 0.8:
            out = r.choice(proper).capitalize()
        elif x < 0.9:
            out = syllables(1)
        else:
            out = r.choice(plain).capitalize()
        if r.random() < 0.03:
            out = accented(out)
        y = r.random()
        return f"{r.choice(('O', 'D'))}'{out}" if y < 0.03 else f"{out}-{syllables(2)}" if y < 0.06 else f"{r.choice(('de', 'van', 'von', 'al', 'de la', 'van der'))} {out}" if y < 0.09 else out

    def person(sure: bool = True) -> str:
        """A name; a sure one stands with a cue, so that any word may be its first."""
        g, s, i = first(sure).capitalize(), last(), letter()
        title = r.choice(("Mr", "Ms", "Mrs", "Dr", "Miss", "Mx", "Prof"))
        plain_ways = (f"{g} {s}", f"{g} {s}", f"{g} {s}", f"{g} {s}", f"{g} {i} {s}", f"{g} {i}. {s}", f"{s}, {g}", f"{s} {g}", f"{s}, {g} {i}", f"{g} {first(sure).capitalize()} {s}")
        short_ways = (f"{title} {s}", f"{title}. {s}", f"{title} {g} {s}", f"{i}. {s}", f"{i} {s}", f"{s}, {i}.", f"{s} {i}", f"{s}, {i}")
        return case(r.choice(plain_ways if r.random() < 0.65 or len(s) < 4 else short_ways))

    def email() -> str:
        name = r.choice((f"{syllables(2)}.{syllables(3)}", f"{syllables(3)}_{syllables(2)}", f"{syllables(3)}+{word()}", f"{r.choice(given)}{digits('99')}", f"{syllables(3)}-{syllables(2)}", f"{syllables(3)}_{r.choice(given)}", f"{r.choice(given)}-{syllables(2)}")).lower()
        host = f"{r.choice((syllables(2), word()))}.{r.choice(('test', 'example', 'invalid', 'com', 'org', 'co.uk', 'de'))}".lower()
        spelt = f"{name} at {host.replace('.', ' dot ')}"
        return r.choice((case(f"{name}@{host}"), f"{name}@mail.{host}", f"{name} (at) {host}", spelt, spelt.replace(".", " dot ")))

    def grouped() -> str:
        sizes = [r.choice((2, 3, 3, 4, 4, 5)) for _ in range(r.randint(2, 4))]
        while sum(sizes) > 12:
            sizes.pop()
        return r.choice(("", "0", "+", "00"))[: 12 - sum(sizes)] + r.choice((" ", "-", ".", "/", " ")).join(digits("9" * k) for k in sizes)

    def phone() -> str:
        known_ways = ("+1 999 555 0199", "+19995550199", "999-555-0199", "(999) 555-0199", "999.555.0199", "999 555 0199 x99", "555-0199", "+44 20 7946 0999", "020 7946 0999", "+49 30 23125 999", "030/23125-999", "9995550199", "0999-99999999", "+999 99 999 9999")
        return grouped() if r.random() < 0.2 else digits(r.choice(known_ways))

    def id_number() -> tuple[str, str]:
        return r.choice((
            ("SSN", "999-99-9999"), ("SSN", "999 99 9999"), ("ssn:", "999999999"), ("ITIN", "999-99-9999"), ("", "999-99-9999"), ("NINO", f"QQ999999{r.choice('ABCD')}"), ("NI no.", f"QQ 99 99 99 {r.choice('ABCD')}"), ("passport", f"{letter()}{letter()}9999999"), ("Passport No:", f"{letter()}99999999"),
            ("DNI", f"99999999-{letter()}"), ("NIE", f"X9999999{letter()}"), ("tax id (person)", "99-9999999"), ("driver lic", f"{letter()}999-9999-9999"), ("Steuer-ID", "99 999 999 999"), ("licence", f"{letter()}999999{letter()}9{letter()}"), ("national insurance", f"{letter()}{letter()}999999{letter()}"), ("identity card", f"{letter()}{letter()}{letter()}999999"),
        ))

    def address() -> str:
        name = lambda: r.choice((syllables(3), syllables(2), r.choice(proper).capitalize(), r.choice(plain).capitalize()))
        town = f", {name()} {r.choice(sorted(STATES))} {digits('99999')}"
        us = f"{r.randint(1, 1999)} {r.choice(('', '', 'N ', 'SW ', 'Old '))}{name()} {r.choice(('', '', syllables(2) + ' '))}{r.choice(_STREETS).capitalize()}{r.choice(('', '', ' Apt 12', ' #9', ', Unit B', ' Suite 400'))}{r.choice(('', '', town))}"
        suffix = r.choice(("weg", "gasse", "platz", "allee", "str.", "straße", "gatan", "vägen", "gade", "straat", "laan"))
        german = f"{syllables(r.randint(1, 3))}{suffix} {r.randint(1, 150)}{r.choice(('', '', ' Hinterhaus', ', 3. OG') if suffix in ('weg', 'gasse', 'platz', 'allee', 'str.') else ('',))}"
        return case(r.choice((us, us, us, german, german, f"Rua da {name()} {name()} {r.randint(1, 99)}", f"Calle {name()} {r.randint(1, 99)}, 3B", f"via del {name()} {r.randint(1, 99)}", f"{r.randint(1, 99)} rue des {name()} {name()}")))

    def organisation() -> str:
        a, b, trade = syllables(r.randint(2, 5)), syllables(r.randint(2, 4)), r.choice(trades).capitalize()
        x = r.random()
        name = f"{a} {b}" if x < 0.2 else f"{a} {b} {trade}" if x < 0.6 else f"{a} {b} {r.choice(trades).capitalize()} {trade}" if x < 0.7 else f"{r.choice(proper).capitalize()} {trade}" if x < 0.75 else f"{word().capitalize()} {word().capitalize()} {trade}" if x < 0.8 else f"{r.choice(proper).capitalize()} {word()}" if x < 0.84 else f"{a} and {b}" if x < 0.85 else f"{a} {b} {r.choice(('+', '&', 'and'))} Sons" if x < 0.87 else f"{b} {a} {r.choice(('Hdwe', 'Mkt', 'Prop Mgt', 'Svcs', 'GmbH', 'LLC', 'Inc'))}"
        if r.random() < 0.15:
            name = f"{_bones(a)} {b}{r.choice(('', ' ' + trade))}"
        if r.random() < 0.1:
            name = f"{b}, {a} {trade}"
        if r.random() < 0.3:
            name += r.choice((f" #{digits('9999')}", f" STORE {digits('999')}", f"*{digits('99999')}", f" {digits('9999')} {r.choice(('', '', 'Old ', 'New '))}{syllables(3)} {r.choice(sorted(STATES))}", f" {syllables(3)} {r.choice(sorted(STATES))}", f" {letter()}", f" {syllables(3)} Falls {r.choice(sorted(STATES))}"))
        lead = r.choice(_CHANNELS) if r.random() < 0.3 or " " in name and x < 0.1 else ""
        return case(f"{lead}{'' if lead.endswith(('*', ' ')) or not lead else ' '}{name}")

    def harmless() -> str:
        g = r.choice(given if r.random() < 0.6 else nick).capitalize()
        return case(r.choice((
            words(1, 4), words(2, 4), words(1, 3), abroad(), abroad(), abroad(), f"{words(1, 2)} {number()}", f"{words(1, 2)} {number()} {word()}", f"{words(1, 2)} {number()} {words(1, 2)} {number()}", f"{g} {words(1, 2)}", f"{g} {words(2, 2)}", f"{g} {words(1, 2)}", f"{g} {r.choice(frequent)} {word()}", f"{g} {r.choice(frequent)}", f"{g.lower()} {r.choice(frequent)} {r.choice(frequent)}", f"{g.lower()} {word()} x{r.randint(1, 9)}", f"{words(1, 1)} {g} {words(1, 2)}", f"{words(1, 2)} x{r.randint(1, 9)}",
            f"{word()} {r.choice(('for', 'from', 'with', 'to'))} {g}", f"{word()} {r.choice(('for', 'from', 'with', 'to'))} {g} {letter()}", f"{g} {letter()}", g, f"{r.choice(proper)} {word()}", f"{word()} {r.choice(('for', 'at', 'of', 'and', 'to'))} {words(1, 2)}", f"visit {word()}.{syllables(2).lower()}.test for {word()}", f"see {word()} @ {word()} {r.randint(1, 9)}",
            f"order {digits('9999-99999')} {word()}", f"{r.choice(('trace', 'conf', 'ref', 'batch', 'auth', 'inv', 'serial', 'ach trace', 'docket', 'part no', 'check'))} {digits(r.choice(('999999999999', '99999', '999999', '99-999-9999', f'999999999{letter()}', '9999')))}", f"{r.choice(('card purchase', 'posted', words(1, 2)))} {digits('202')}{r.randint(0, 9)}-0{r.randint(1, 9)}-{r.randint(10, 28)}",
            f"{r.choice(('ref', 'online transfer', word()))} {letter()}{letter()}{letter()}-{letter()}{letter()}{letter()}-{digits('99999')}", f"{word()} {r.choice(('payee', 'acct', 'inst'))}-{digits('999')}".upper(), f"{words(1, 2)} {organisation()}", f"{organisation()} {word()}", f"{organisation()} {r.choice(('Tisch', 'table', 'ref', 'inv'))} {r.randint(1, 9999)}", f"{r.choice(('fx rate', 'terminal', 'unit', 'room', 'lane', 'seat', 'tbl'))} {number()} {r.choice(('', word(), 'of 5'))}", f"{syllables(4)}{syllables(2).lower()}.com",
        )))

    def around(kind: str, bare: bool = False) -> tuple[str, str, str]:
        """(text before, value, text after); nothing before a bare value."""
        tail = r.choice(("", "", "", f" {words(1, 2)}", f" {word()}", f", {word()}", f" - {words(1, 2)}", f" {number()}"))
        if kind == "person_name":
            x = r.random()
            if x < 0.3:
                return "", person(False), r.choice(("", "", "", tail))
            if x < 0.5:
                lead = case(r.choice(_LEADS))
                return lead + ("" if lead.endswith("*") else " "), person(), r.choice(("", "", tail))
            if x < 0.66:
                return f"{words(1, 2)} {r.choice(('for', 'from', 'with', 'by', 'to', 'of'))} ", person(), tail
            if x < 0.84:
                return "", person(False), f" {words(1, 3)}"
            return f"{words(1, 2)} ", person(False), r.choice(("", f" {r.choice(('for', 'on', 'at', 'and', 'to'))} {words(1, 2)}"))
        if kind == "id_number":
            cue, value = id_number()
            return r.choice(("", f"{words(1, 2)} ", f"{word()} for ")) + (f"{cue} " if cue else ""), digits(value), tail
        lead = {
            "email": (f"{words(1, 1)} ", f"{words(1, 2)} to ", "contact ", "e-mail ", "email: ", "", "", "<"),
            "phone": ("call ", "callback ", "ring ", "tel ", "tel. ", "mobile ", "phone: ", "text ", "", f"{words(1, 2)} ", f"if {word()} call "),
            "street_address": ("deliver to ", "delivered to ", "moved to ", "service at ", "", "", f"{words(1, 2)} at ", f"{words(1, 2)} ", f"{words(1, 2)}, ", "keys "),
        }[kind]
        value = {"email": email, "phone": phone, "street_address": address}[kind]()
        lead = r.choice(lead)
        if kind == "phone" and not bare and (value[0] in "0" or not re.match(r"[+(]|\d{3}[-. ]\d{3}[-. ]\d{4}|\d{3}-\d{4}$|\d{10}$", value)) and not lead.startswith(("call", "ring", "tel", "mob", "pho", "text", "if")):
            lead = "call "  # bare groups of digits are a phone's only with a cue
        if bare and lead != "<" and re.match(r"\+\d|[(]?\d{3}[-. )]+\d{3}[-. ]\d{4}|\d{3}-\d{4}$|0\d{2}[ /]", value) or bare and kind != "phone":
            lead = ""
        return case(lead) if lead != "<" else lead, value, ">" if lead == "<" else tail

    out = []
    for _ in range(count):
        text, gold = "", []
        for k in range(r.choice((1, 1, 1, 1, 2, 2, 3))):
            if k:
                text += r.choice(("; ", " / ", " | ", ". ", " - ", " "))
                if text.endswith(("y ", "d ")) and text[-2].isalpha():
                    text = text.rstrip() + "; "
            if r.random() < 0.5:
                text += organisation() if r.random() < 0.4 else harmless()
                continue
            bare = False
            if not k and r.random() < 0.35:  # a payee with a way to reach someone behind it
                named = r.random() < 0.5
                name, kind = person(False) if named else organisation(), r.choice(("email", "phone", "id_number", "street_address"))
                if named:
                    gold.append(Span("person_name", 0, len(name)))
                text += f"{name} "
                bare = r.random() < 0.6
            else:
                kind = r.choice(("email", "phone", "id_number", "street_address", "person_name", "person_name", "person_name"))
            before, value, after = around(kind, bare)
            text += before
            gold.append(Span(kind, len(text), len(text) + len(value)))
            text += value + after
        out.append((text, gold))
    return out


def _slip(r: random.Random, name: str) -> str:
    """The name with one letter left out, doubled or swapped."""
    i = r.randrange(1, max(2, len(name) - 1))
    return r.choice((name[:i] + name[i + 1 :], name[:i] + name[i] + name[i:], name[: i - 1] + name[i : i + 1] + name[i - 1 : i] + name[i + 1 :]))


def _bones(name: str) -> str:
    return name[0] + re.sub("[aeiou]", "", name[1:])
