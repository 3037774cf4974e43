"""Labelled spans to train the tagger on: seeded texts in six languages with marked personal information.

A text is made of sentences. A sentence with personal information puts a slot between two freely combined phrases, into a
run of ordinary or of made-up words, or beside other slots; names, streets, domains and numbers come from lists and from
rules (syllables, compounds, groups of digits), so that the tagger sees few of them twice. Ordinary sentences are full of
what only looks like personal information: places, dates, part numbers, handles, streets without a number, things that
bear a given name.

Nothing here comes from the corpus: no list, phrase or form was taken from it, which a test holds against
``documents``. pii_words.HELD shares no name, street, domain or phrase with what is trained on, and measures the tagger.
"""

from __future__ import annotations

import random

from netweave.llm.pii_words import TRAINED

KINDS = ["email", "phone", "id_number", "address", "name"]
LANGUAGES = ["en", "de", "fr", "es", "ru", "zh"]

# Titles, particles, weekdays and the forms of numbers; # is a digit, ~ one separator throughout.
INITIALS = "ABCDEFGHIJKLMNOPRSTUVWXYZ"
PARTICLES = ["von", "van", "de la", "del", "de", "di", "van der", "da", "le", "al"]
TITLES = {
    "en": ["Mr", "Ms", "Mrs", "Dr.", "Mr.", "Prof.", "Dr", "Sir"], "de": ["Herr", "Frau", "Dr.", "Herrn", "Prof."], "fr": ["M.", "Mme", "Dr", "Mlle", "Madame"], "es": ["Sr.", "Sra.", "don", "doña", "Dra.", "D.", "Dña.", "señor"],
    "ru": ["г-н", "г-жа", "д-р", "проф."], "zh": [],
}
WEEKDAYS = {
    "en": "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split(), "de": "Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag".split(), "fr": "lundi mardi mercredi jeudi vendredi samedi dimanche".split(),
    "es": "lunes martes miércoles jueves viernes sábado domingo".split(), "ru": "понедельник вторник среда четверг пятница суббота воскресенье".split(), "zh": "星期一 星期二 星期三 星期四 星期五 星期六 星期日".split(),
}
PHONES = {
    "en": ["+1~###~###~####", "###~###~####", "1~###~###~####", "(###) ###-####", "###-###-#### ext. ##", "###-###-#### x###", "0## #### ####", "0#### ######", "0#### ### ###", "+44 #### ######", "+44 (0)## #### ####", "+61 # #### ####", "###.###.####", "###.###.####", "####~####~###"],
    "de": ["+49~##~#####~###", "+49~###~#######", "0##~######", "0### #######", "(0###) ####~###", "01##/#######", "+49 (0)## ##### ###", "0049~##~######", "0## / ## ## ##", "+43~#~#######", "+41 ## ### ## ##"],
    "fr": ["+33~#~##~##~##~##", "0#~##~##~##~##", "+33 (0)# ## ## ## ##", "0033~#~##~##~##~##", "0#########", "+32 # ### ## ##", "0#.##.##.##.##", "0# ## ## ## ##"],
    "es": ["+34~###~###~###", "0034~###~######", "###~##~##~##", "###~###~###", "9########", "+34 #########", "+52 ## #### ####", "###.###.###", "6## ## ## ##"],
    "ru": ["+7 (###) ###-##-##", "8~###~###~##~##", "+7##########", "8 (###) ###-##-##", "8##########", "(###) ###-##-##", "+375 ## ###-##-##"],
    "zh": ["+86~##~####~####", "(0##) ####-####", "0##-########", "1##########", "1##~####~####", "+86 1##########", "0###-#######", "0##~####~####"],
}
IDENTITIES = {
    "en": ["###~##~####", "@@~##~##~##~@", "@@######@", "@########", "###-##-####", "@@######"], "de": ["##~###~###~###", "###########", "@##@#####", "@########", "## ###### @ ###", "@@#######"], "fr": ["#~##~##~##~###~###~##", "###############", "#############", "##@@#####", "# ## ## ## ### ###"],
    "es": ["########~@", "##.###.###~@", "########@", "@#######@", "@-#######-@", "##-########-##"], "ru": ["###-###-###~##", "####~######", "## ## ######", "############", "##-## ######"], "zh": ["######19##0#######", "######19##1######@", "######20##0#######", "@########", "@#######(#)", "##################"],
}
TECHNICAL = [
    "20##-0#-##", "20##-0#-## 1#:##", "0#.0#.20##", "1#/0#/20##", "1#:##", "1#:##:##", "###-####", "####-####", "##-####", "@@-####", "@###-##", "########@", "#######", "########", "##########", "###.####.##", "#### ### ##", "v#.#.##", "#.##.#", "10.##.##.#",
    "192.168.#.###", "?@#.###.#", "?-####", "%%##%#%##", "#%##%%##%#%%", "0x%%##%%", "ISBN 978-#-###-#####-#", "##.#####, ##.#####", "### ### kWh", "#.### EUR", "$#,###.##", "## × ##", "##°##'", "@@##@##", "+## %", "-##.#", "#:##", "?/##/####", "#?####?", "########.###",
]
NOISE = ["", "", "👍🏼", "🚲 ok", "<br>", "&nbsp;", "<|end|>", "</s>", "2.718281828", "日本語", "हिन्दी ग", "ελληνικά", "...?!", "\t", "�", "ℜ𝔢𝔡", "***", "#1", "we'd she'll IT'S", "‮abc‬", " \xa0 ", "HaHaHa", "\n\nYoYo", "https://www.example.com/p?id=1234567", "ftp://files.test/a-b_c.zip"]


DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def dni_letter(digits: str) -> str:
    """The check letter of a Spanish identity number."""
    return DNI_LETTERS[int(digits) % 23]


class Spans:
    """Seeded maker of (text, [(start, end, kind)]) from lists of words and rules."""

    def __init__(self, seed: int, words: dict = TRAINED, invented: bool = True):
        self.r, self.w, self.invented = random.Random(seed), words, invented

    def _chance(self, p: float) -> bool:
        return self.r.random() < p

    def _filled(self, form: str) -> str:
        """A form with its digits (#), letters (@), hex letters (%), words (?) and one separator (~) chosen."""
        r = self.r
        gap = r.choice([" ", " ", "-", "-", ".", ""])
        made = {"#": lambda: str(r.randint(0, 9)), "@": lambda: r.choice(INITIALS), "%": lambda: r.choice("abcdef"), "?": lambda: self._syllables(False).lower(), "~": lambda: gap}
        return "".join(made[c]() if c in made else c for c in form)

    # ---- words and names

    def _syllables(self, ru: bool) -> str:
        a, b, c = ("бвгдклмнпрстф", "аеиоуя", "лмнрст") if ru else ("bcdfghjklmnprstvwz", "aeiouy", "lmnrstkd")
        r = self.r
        s = "".join((r.choice(a) if i or r.random() < 0.8 else "") + r.choice(b) + (r.choice(c) if r.random() < 0.45 else "") for i in range(r.choice([2, 2, 2, 3])))
        return s.capitalize()

    def _given(self, ru: bool) -> str:
        if self.invented and self._chance(0.35):
            s = self._syllables(ru)
            return s if ru or self._chance(0.4) else s.rstrip("aeiouy") + self.r.choice(["a", "o", "e", "ia", "us", "is", "in", "el", "an", "a", "ine", "ric", "am", "ert"])
        return self.r.choice(self.w["given_ru" if ru else "given"])

    def _compound(self) -> str:
        return self.r.choice(self.w["heads"]) + self.r.choice(["", "", "e", "en", "er", "o"]) + self.r.choice(self.w["tails"])

    def _family(self, ru: bool) -> str:
        if self.invented and self._chance(0.55):
            if ru:
                return self._syllables(True) + self.r.choice(["ов", "ева", "ин", "ская", "ук", "о", "ер", "ино", "ен", ""])
            return self._compound() if self._chance(0.55) else self._syllables(False) + self.r.choice(["", "", "n", "r", "ski", "ez", "ov", "sen", "ini", "ard", "elo"])
        return self.r.choice(self.w["family_ru" if ru else "family"])

    def name(self, lang: str) -> tuple[str, str]:
        """(title with space, name)."""
        r, ru = self.r, lang == "ru" and self._chance(0.65)
        if lang == "zh" and self._chance(0.25):
            return "", r.choice(self.w["surname_zh"]) + "".join(r.choice(self.w["given_zh"]) for _ in range(r.choice([1, 2, 2])))
        given, family = self._given(ru), self._family(ru)
        if self._chance(0.1):
            family += "-" + self._family(ru)
        if self._chance(0.1):
            given += r.choice(["-", " "]) + self._given(ru)
        if not ru and self._chance(0.12):
            family = r.choice(PARTICLES) + " " + family
        form = r.random()
        name = f"{given} {family}" if form < 0.62 else f"{family}, {given}" if form < 0.74 else f"{given[0]}. {family}" if form < 0.86 else f"{given} {r.choice(INITIALS)}. {family}" if form < 0.96 else f"{given[0]}. {r.choice(INITIALS)}. {family}"
        if self._chance(0.08):
            name = name.upper()
        return (r.choice(TITLES[lang]) + " " if TITLES[lang] and self._chance(0.18) else ""), name

    def email(self) -> str:
        r = self.r
        g, f = self._given(False).lower(), self._family(False).lower().replace("'", "")
        local = r.choice([f"{g}.{f}", f"{g}_{f}", f"{g[0]}{f}", f"{f}{r.randint(0, 99):02d}", f"{g}+{r.choice(self.w['domains'])}", f"{g[0]}.{f}-{r.randint(0, 9)}", f"{g}-{f}", f, "info", f"{g}{r.randint(1900, 2010)}"])
        host = r.choice(self.w["domains"]) if self._chance(0.6) or not self.invented else self._syllables(False).lower()
        domain = r.choice([host, host, f"{host}-{r.choice(self.w['domains'])}", f"mail.{host}"]) + "." + r.choice(self.w["suffixes"])
        form = r.random()
        mail = f"{local}@{domain}" if form < 0.72 else f"{local} (at) {domain}" if form < 0.79 else f"{local}[at]{domain}" if form < 0.83 else f"{local} [at] {domain.replace('.', ' [dot] ')}" if form < 0.91 else f"{local} @ {domain}"
        return mail.upper() if self._chance(0.1) else mail

    def phone(self, lang: str) -> str:
        s = self._filled(self.r.choice(PHONES[lang if self._chance(0.75) else self.r.choice(LANGUAGES)]))
        return "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in s) if lang == "zh" and self._chance(0.08) else s

    def identity(self, lang: str) -> str:
        form = self.r.choice(IDENTITIES[lang if self._chance(0.75) else self.r.choice(LANGUAGES)])
        s = self._filled(form)
        return s[:-1] + dni_letter("".join(c for c in s if c.isdigit())) if form[0] == "#" and form[-1] == "@" and form.count("#") == 8 else s

    # ---- places

    def street(self, lang: str) -> str:
        r, kind = self.r, self.r.choice(self.w["street_kinds"][lang])
        made = self.invented and lang != "zh" and self._chance(0.4)
        word = (self._syllables(lang == "ru") if self._chance(0.5) or lang == "ru" else self._compound()) if made else r.choice(self.w["street_words"][lang])
        if lang == "zh":
            return (word + (r.choice(self.w["given_zh"]) if self._chance(0.3) else "") if self._chance(0.6) else "".join(r.choice("桥门河山湖港柳水北南东西新旧石井") for _ in range(2))) + kind
        if lang == "en":
            return f"{r.choice(['', '', '', *self.w['adjectives']['en']])} {word} {kind}".strip() if self._chance(0.85) else f"{word} {r.choice(self.w['street_words']['en'])} {kind}"
        if lang == "de":
            form = r.random()
            return word + kind if form < 0.6 else f"{word}er {kind.capitalize()}" if form < 0.72 else f"{r.choice(self.w['adjectives']['de'])} {kind.capitalize()}" if form < 0.82 else f"{r.choice(['Am', 'An der', 'Im', 'Zum', 'Zur', 'Hinter dem'])} {r.choice([word, word + kind])}"
        if lang == "ru":
            return f"{word} {kind}" if self._chance(0.3) else f"{kind} {r.choice(['', '', '', 'Старой ', 'Новая '])}{word}"
        link = r.choice(["", "du ", "de la ", "des ", "de "] if lang == "fr" else ["", "de ", "del ", "de la ", "de las ", "de los "])
        return f"{kind} {link}{word}{r.choice(['', '', '', ' ' + self._syllables(False)])}"

    def address(self, lang: str) -> str:
        r = self.r
        street, no = self.street(lang), str(r.randint(1, 260))
        if lang == "en":
            return f"{no}{r.choice(['', '', '', '', 'A', 'b', '-' + str(int(no) + 2)])} {street}" + r.choice(["", "", "", f", Flat {r.randint(1, 9)}", f", Apt {r.randint(1, 40)}"])
        if lang == "de":
            return f"{street} {no}{r.choice(['', '', '', 'a', ' b', f'-{int(no) + 2}'])}"
        if lang == "fr":
            return f"{no}{r.choice(['', '', '', ' bis', ' ter'])}{r.choice([',', '', ''])} {street}"
        if lang == "es":
            return f"{street}{r.choice([',', '', ' n.º'])} {no}" + r.choice(["", "", f", {r.randint(1, 9)}.º {r.choice('ABCD')}"])
        if lang == "ru":
            return f"{street}, {r.choice(['', '', 'д. ', 'дом '])}{no}" + r.choice(["", "", "", f", кв. {r.randint(1, 90)}", "а"])
        return f"{street}{r.choice(['', ' '])}{no}{r.choice(['', ' '])}号" + r.choice(["", "", f"{r.randint(1, 9)}楼"])

    def town(self) -> str:
        s = self.r.choice(self.w["heads"]) + self.r.choice(["", "", *self.w["heads"]]).lower() + self.r.choice(self.w["towns"])
        return s if self._chance(0.7) else self._syllables(False) + self.r.choice(self.w["towns"])

    def thing(self, lang: str) -> str:
        """Capitalised words that are no person."""
        r, thing, adjective = self.r, self.r.choice(self.w["things"][lang]), self.r.choice(self.w["adjectives"][lang])
        own = r.choice([self.town(), self.town(), self.town(), self._given(lang == "ru"), self._family(lang == "ru")])
        if lang == "zh":
            return r.choice([f"{own} {thing}", f"{own}{thing}", adjective + thing])
        if self._chance(0.25):
            noun = r.choice([*self.w["nouns"][lang], thing])
            return f"{r.choice([noun[0].upper() + noun[1:], self._syllables(lang == 'ru')])} {r.choice(self.w['links'][lang])}{self.town()}"
        first = [f"{own} {thing}", f"{adjective} {thing}", f"{thing} {own}", f"{adjective} {self.town()}", f"{self.town()} {thing}"]
        if lang == "de":
            first += [f"{own}-{thing}", f"{thing} {self.town()}", f"{r.choice(self.w['nouns']['de'])}{thing.lower()} {self.town()}"]
        if lang in ("fr", "es"):
            first += [f"{thing} {own}", f"{thing} de {self.town()}"]
        return r.choice(first)

    # ---- sentences

    def _number(self, lang: str) -> str:
        """A number that is no personal information, with its unit."""
        r, n = self.r, str(self.r.randint(1, 999))
        unit = r.choice(self.w["units"][lang])
        if lang == "zh":
            return r.choice(["第", "", "", "约", "共", r.choice(self.w["numbered"]["zh"])]) + r.choice([n, f" {n} "]) + unit
        return f"{n} {unit}" if self._chance(0.45) else f"{r.choice([r.choice(self.w['numbered'][lang]), r.choice(self.w['nouns'][lang])])} {n}" if self._chance(0.6) else n

    def _words(self, lang: str, n: int) -> str:
        """Ordinary words, or made-up ones, in no grammar."""
        r, out = self.r, []
        if n > 1 and self._chance(0.4):
            start = r.choice(self.w["starts"][lang])
            if lang == "de" and self._chance(0.4):
                stem = r.choice(self.w["stems"]) if self._chance(0.6) else self._syllables(False).rstrip("aeiouy")
                start = stem.capitalize() + r.choice(["er", "er", "e", "es", "en", "em", "liche", "ige", "ischer"])
            out.append(start + ("" if lang == "zh" else " ") + r.choice([r.choice(self.w["nouns"][lang]), r.choice(self.w["nouns"][lang]), r.choice(WEEKDAYS[lang]), self.town()]))
        elif n > 1 and self._chance(0.15):
            out.append(self._number(lang))
        for _ in range(n - len(out)):
            form = r.random()
            if lang == "zh" and form < 0.5:
                word = "".join(r.choice(self.w["han"]) for _ in range(r.randint(1, 5)))
            elif form < 0.36:
                word = r.choice(self.w["small"][lang])
            elif form < 0.62:
                word = r.choice(self.w["nouns"][lang])
            elif form < 0.7 or (lang == "zh" and form < 0.9):
                word = r.choice(self.w["verbs"][lang])
            elif form < 0.9:
                word = self._syllables(lang == "ru").lower()
            else:
                word = r.choice([self.town(), self._number(lang), self._number(lang), self.thing(lang), self._filled(r.choice(TECHNICAL))])
            out.append(word + (r.choice(",;:") if self._chance(0.06) else ""))
        return ("" if lang == "zh" and self._chance(0.8) else " ").join(out)

    def _value(self, slot: str, lang: str) -> tuple[str, str, str]:
        """What stands before, the item itself, and what stands after it without a space."""
        r = self.r
        if slot == "N":
            return *self.name(lang), ""
        if slot == "E":
            mail = self.email()
            return (*r.choice([("<", mail, ">"), ("mailto:", mail, ""), ("(", mail, ")")]),) if "@" in mail and " " not in mail and self._chance(0.15) else ("", mail, "")
        return "", {"P": self.phone, "I": self.identity, "A": self.address}[slot](lang), ""

    def _plain(self, slot: str, lang: str) -> str:
        r = self.r
        if slot == "n":
            return str(r.randint(1, 999)) if self._chance(0.75) else self._filled(r.choice(["####", "#####", "######", "#######"]))
        if slot == "h":
            return "@" + r.choice([self.town(), self.r.choice(self.w["given"]) + self.r.choice(self.w["heads"])]) + r.choice(["_news", "_info", "", str(r.randint(1, 99))])
        if slot == "d":
            return r.choice(WEEKDAYS[lang])
        return {"t": self.town, "x": lambda: self._filled(r.choice(TECHNICAL)), "w": lambda: self.street(lang), "c": lambda: self.thing(lang), "g": lambda: self._given(lang == "ru")}[slot]()

    def sentence(self, lang: str, plain: bool) -> tuple[str, list[tuple[int, int, str]]]:
        r, out, spans = self.r, "", []

        def put(slot: str) -> None:
            nonlocal out
            lead, value, tail = self._value(slot, lang if self._chance(0.94) else r.choice(LANGUAGES))
            out += lead
            spans.append((len(out), len(out) + len(value), KINDS["EPIAN".index(slot)]))
            out += value + tail

        gap = "" if lang == "zh" and self._chance(0.5) else " "
        end = r.choice(["。", "。", ""] if lang == "zh" else [".", ".", ".", ".", "!", "", "?"])
        if plain:
            if self._chance(0.45):
                words = self._words(lang, r.randint(3, 9))
                if self._chance(0.3):
                    words = r.choice([f"{words}{gap}{self.thing(lang)}", f"{words}{gap}{self.town()}", f"{self.thing(lang)}{gap}{words}", f"{words}{gap}{r.choice(self.w['links'][lang])}{self.town()}"])
                return words[0].upper() + words[1:] + end, spans
            form, at = r.choice(self.w["plain"][lang]), 0
            while (cut := form.find("{", at)) >= 0:
                out += form[at:cut] + self._plain(form[cut + 1], lang)
                at = cut + 3
            return out + form[at:], spans
        slot, how = r.choice("NNNNNNNNNAAAPPPEEIII"), r.random()
        if how < 0.55:
            before, after = self.w["phrases"][lang][slot]
            out = r.choice(self.w["openers"][lang]) + r.choice(before)
            out = out[:1].upper() + out[1:]
            put(slot)
            if slot == "N" and self._chance(0.25):
                other, close = r.choice([(" (", ")"), (", ", ""), (" – ", ""), (", ", ","), ("（", "）") if lang == "zh" else (" <", ">")])
                second = r.choice("EPIAA")
                out += other
                if self._chance(0.5):
                    label = r.choice(self.w["phrases"][lang][second][0])
                    out += label[:1].upper() + label[1:] if self._chance(0.4) else label
                put(second)
                out += close
            elif self._chance(0.12):
                out += r.choice([", ", " / ", " – ", "; ", "、" if lang == "zh" else " " + r.choice(self.w["verbs"][lang]) + " "])
                put(r.choice("NNEPIA"))
            out += r.choice(after) + (r.choice([" ", ", "]) + self._words(lang, r.randint(1, 4)) if self._chance(0.2) else "") + end
        elif how < 0.9:
            # a slot somewhere in a run of words
            lead, rest = r.randint(0, 6), r.randint(0, 6)
            if lead:
                words = self._words(lang, lead)
                out = words[0].upper() + words[1:] + r.choice([gap, gap, gap, ": ", ", ", " – ", " ("])
            closing = ")" if out.endswith("(") else ""
            put(slot)
            out += closing
            if rest:
                out += r.choice([gap, gap, gap, ", ", "; ", " – "]) + self._words(lang, rest)
            out += end
        else:
            # a line of items alone
            link = r.choice([" – ", ", ", " | ", "\n", "; ", " · "])
            for k in range(r.randint(1, 3)):
                out += link if k else ""
                put("N" if not k and self._chance(0.6) else r.choice("EPIA"))
        return out, spans

    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        """Up to four sentences, with noise between some, mostly in one language."""
        r = self.r
        lang, out, spans = r.choice(LANGUAGES), "", []
        for _ in range(r.choice([1, 1, 2, 2, 3])):
            tongue = lang if self._chance(0.94) else r.choice(LANGUAGES)
            part, found = self.sentence(tongue, self._chance(0.48))
            if out and not (lang == "zh" and self._chance(0.8)) and not self._chance(0.03):
                out += r.choice([" ", " ", " ", " ", "\n"])
            spans += [(s + len(out), e + len(out), k) for s, e, k in found]
            out += part
            if self._chance(0.1):
                out += " " + r.choice(NOISE)
        return out, spans
