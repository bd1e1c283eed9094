"""Personal information inside free text, found by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, schemes, international prefixes, words that announce a
telephone, identity, card or account number, titles and phrases that introduce names, and words for streets. From
each anchor a deterministic parser expands to the boundaries of an email address, number, name or postal address,
however far they lie, and validates what it found: lengths, and the check digits of cards and accounts. The parsers
read a shadow of the text without invisible and disguised signs; places are those of the text as stored.
"""

from __future__ import annotations

import functools
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .alike import CYRILLIC, GREEK, INVISIBLE, SPACES, Rewriter, _form, look_alikes

EMAIL, PHONE, IDENTITY, ADDRESS, NAME = "email", "phone", "id_number", "street_address", "person_name"

# What announces numbers, names and addresses in the supported languages, in lower case: this library's own lists, open to more.
AT_SIGNS = ("@", " at ", "[at]", "(at)", "{at}", "＠")
PHONE_CUES = (
    "call me", "reach me on", "phone", "tel.", "tel:", "telephone", "mobile:", "ring me", "rufen sie mich", "telefon", "erreichbar unter", "joindre au", "téléphone", "appelez", "llamarme", "llámenme", "teléfono",
    "ligar-me", "liguem", "telefone", "telemóvel", "по номеру", "телефон", "тел.", "звоните", "連絡先", "電話番号", "请打", "電話は", "电话是", "致电", "โทร", "เบอร์", "फोन", "मुझे", "اتصلوا", "هاتف", "الاتصال",
)
#: These announce a number only if nothing but signs stands between.
DIRECT_CUES = ("my number is", "my mobile is", "my cell is", "reach ", "whatsapp", "fax", "hotline", "handy", "mobil:", "móvil", "celular", "portable", "cellulaire", "電話", "手机", "جوال", "मोबाइल", "มือถือ", "моб.", "whatsapp:")
PREFIXES = ("+", "00")
SCHEMES = ("://",)
CHECKED_CUES = ("iban", "card", "karte", "konto", "carte", "compte", "tarjeta", "cuenta", "cartão", "conta", "карт", "счёт", "счет", "カード", "口座", "卡号", "账号", "บัตร", "บัญชี", "कार्ड", "खाता", "بطاقة", "حساب")
IDENTITY_CUES = (
    "id on file", "social security number", "identity number", "passport", "national id", "ausweisnummer", "personalausweis", "pièce d'identité", "pièce d’identité", "numéro de sécurité", "documento", "dni", "паспорт", "снилс",
    "個人番号", "マイナンバー", "身份证", "บัตรประชาชน", "पहचान संख्या", "आधार", "رقم الهوية", "الهوية",
)
NAME_CUES = (
    "my name is", "i am ", "i'm ", "ich bin ", "je suis ", "soy ", "sou ", "mr. ", "mrs. ", "ms. ", "mr ", "mrs ", "thanks, ", "contact ", "ask for ", "ich heiße", "mein name ist", "frau ", "herr ", "je m'appelle", "je m’appelle", "mme ", "m. ", "monsieur ", "madame ", "me llamo", "mi nombre es",
    "sra. ", "sr. ", "señora ", "señor ", "chamo-me", "meu nome é", "меня зовут", "ведёт", "ведет", "г-н ", "г-жа ", "我叫", "我是", "经办人是", "担当は", "と申します", "ชื่อ", "คุณ", "मेरा नाम", " जी ", "اسمي", "والمسؤول هو", "السيد ", " at the desk",
)
STREET_CUES = (
    " street", " lane", " court", " road", " avenue", " drive", " close", " rise", " way", " square", " terrace", " crescent", "adresse lautet", "straße ", "strasse ", "weg ", "pfad ", "allee ", "gasse ", "platz ",
    "rue ", "impasse ", "allée ", "avenue ", "chemin ", "boulevard ", "place ", "quai ", "calle ", "avenida ", "plaza ", "paseo ", "camino ", "rua ", "travessa ", "largo ", "praça ", "estrada ",
    "ул. ", "пер. ", "пр. ", "пл. ", "улица ", "送り先は", "住所は", "寄到", "地址是", "ถนน", "ซอย", "रोड", "मार्ग", "गली", "पथ", "شارع ", "طريق ", "حي ", "رقم ",
)

#: These also begin much else, so a name after them must be written as one.
LOOSE_NAME_CUES = ("i am ", "i'm ", "ich bin ", "je suis ", "soy ", "sou ")
PREFIX, DIRECT, CHECKED, SCHEME = "prefix", "direct", "checked", "scheme"
_CUES = ((EMAIL, AT_SIGNS), (PHONE, PHONE_CUES), (DIRECT, DIRECT_CUES), (PREFIX, PREFIXES), (IDENTITY, IDENTITY_CUES), (CHECKED, CHECKED_CUES), (SCHEME, SCHEMES), (NAME, NAME_CUES), (ADDRESS, STREET_CUES))
_KIND = {DIRECT: PHONE, PREFIX: PHONE, CHECKED: IDENTITY}
_BLANKS = frozenset(SPACES + " \t")
_WIDTH = {c: " " for c in _BLANKS} | {chr(c): _form(chr(c)) for c in range(0xFF10, 0xFF5B) if unicodedata.category(chr(c)) in ("Nd", "Lu", "Ll")} | {"‑": "-", "’": "'"}


class Finder:
    def __init__(self) -> None:
        import ahocorasick
        import regex

        self.automaton = ahocorasick.Automaton()
        kinds: dict[str, list[str]] = {}
        for kind, cues in _CUES:
            for cue in cues:
                kinds.setdefault(cue.replace("’", "'"), []).append(kind)
        for cue, found in kinds.items():
            self.automaton.add_word(cue, (found, cue))
        self.automaton.make_automaton()
        self.rewriter = Rewriter(*look_alikes({c: 0 for c in (*CYRILLIC, *GREEK)}))
        c = functools.partial(regex.compile, flags=regex.V1)
        i = functools.partial(regex.compile, flags=regex.V1 | regex.I)
        dot = r"(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot )"
        self.local_signs = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._+%'-")
        self.local = i(r"[a-z0-9](?:[a-z0-9._+%'-]*[a-z0-9])?$")
        self.iban = i(r"(?<![a-z0-9])[a-z]{2}\d{2}(?: ?[a-z0-9]){11,30}(?![a-z0-9])")
        self.card = c(r"(?<!\d)\d(?:[ -]?\d){12,18}(?![\d])")
        self.domain = c(rf" ?((?:[A-Za-z0-9]|(?<=[A-Za-z0-9])-(?=[A-Za-z0-9]))+(?:{dot}[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)+)")
        self.label = i(dot)
        self.phone = i(r"(?:\+ ?)?\(?\d(?:[ .\-/()]{0,2}\d){5,14}(?!\d)(?:,? ?(?:ext\.?|extension|x|durchwahl|доб\.?|poste|int\.?|ramal) ?\d{1,5})?")
        self.identity = i(r"(?<![a-z0-9])(?:[a-z]\d?[a-z0-9]{1,2} \d{5,9}(?!\d)|[a-z]{2} \d(?:[ .\-]?\d){4,16} ?[a-z](?![a-z])|(?:[a-z]{1,2})?\d(?:[ .\-]?\d){5,19}[a-z]?(?![a-z0-9])|(?=(?:[a-z]*\d){6})[a-z0-9]{8,12}(?![a-z0-9]))")
        initial, word = r"\p{Lu}\.", r"\p{Lu}[\p{Ll}\p{M}']+(?:-\p{Lu}[\p{Ll}\p{M}']+)*"
        loose = r"[\p{L}\p{M}']+(?:-[\p{L}\p{M}']+)*"
        self.name = c(rf"(?:{initial}|{word}) {{1,3}}{word}")
        self.loose_name = c(rf"(?:\p{{L}}\.|{loose}) {loose}")
        town, loose_town = rf"{word}(?: {word})?", rf"{loose}(?:(?<=\b(?:san|los|las|são|santa|saint|st)) {loose})?"
        self.streets = [
            (i, rf"(?:(?:flat|unit|apt\.?|apartment) \d+\w?, )?\d+[a-z]? (?:{loose} ){{1,4}}?(?:street|lane|court|road|avenue|drive|close|rise|way|square|terrace|crescent)\b(?:, (?:apt\.?|flat|unit|apartment|suite) \d+\w?)?(?:, (?:[A-Z]{{1,2}}\d+ ?\d[A-Z]{{2}} )?(?!please|por |in )TOWN(?: [A-Z]{{1,2}}\d\d? \d[A-Z]{{2}})?)?"),
            (i, rf"(?<=adresse lautet )(?:{loose} ){{1,4}}?\d+[a-z]?\b(?:,? \d{{5}} TOWN| in TOWN|, (?!die |der |das )TOWN)?"),
            (i, rf"(?<![\p{{L}}])(?:(?!lautet |im |in |am |an ){loose} )?{loose}(?:straße|strasse|weg|pfad|allee|gasse|platz) \d+[a-z]?\b(?:,? \d{{5}} TOWN| in TOWN)?"),
            (i, rf"\d+(?: (?:bis|ter))?,? (?:rue|impasse|allée|avenue|chemin|boulevard|place|quai|route|cours) (?:(?:de|du|des|la|le|les) |[dl]'| )*{loose}(?: (?!dès|pour|et|est)\p{{Lu}}{loose})*(?:, (?:\d{{5}} )?(?!dès|pour|et )TOWN)?"),
            (i, rf"(?:calle|avenida|plaza|paseo|camino|rua|travessa|largo|praça|estrada) (?:{loose} ){{0,5}}?{loose},? (?:n\.?[º°o]\.? ?)?\d+[a-z]?\b(?:, (?:piso|puerta|andar|esc\.?) \w+)*(?:, \d{{4,5}}(?:-\d{{3}})? TOWN|, (?!por |se |please)TOWN)?"),
            (i, rf"(?:{loose}, )?(?:\d{{6}}, )?(?:ул|пер|пр|пл|наб|ш|б-р)\. (?:{loose} ?){{1,4}}, д\. ?\d+ ?[а-я]?\b(?:, (?:корп|стр|к|кв|оф)\. ?\d+)*(?:, (?:\d{{6}}, )?{loose}(?:-{loose})?)?"),
            (c, r"(?:〒? ?\d{3}-\d{4} ?)?[\p{Han}\p{Katakana}\p{Hiragana}ー--[はで]]+[市町村区郡][\p{Han}\p{Katakana}\p{Hiragana}ー]*?[0-9]+(?:[-‐−][0-9]+)*(?:号室?|番地?)?"),
            (c, r"(?<=寄到|地址是|送到|地址：)\p{Han}*?[路街巷道弄里] ?\d+ ?号(?: ?\d+ ?[室楼号])*"),
            (c, r"\d+(?:/\d+)? (?:หมู่ \d+ )?(?:ถนน|ซอย)[\p{Thai}\p{M}]+(?: (?!ด้วย|นะ|ค่ะ|ครับ|และ|\d)[\p{Thai}\p{M}]+)?(?: \d{5}\b)?"),
            (c, r"(?:मकान (?:नं\. ?)?|फ्लैट )?\d+, [\p{Devanagari}\p{M} ]+?(?:रोड|मार्ग|गली|पथ)(?:, (?!पर )[\p{Devanagari}\p{M}]+)?"),
            (c, r"(?:شارع|طريق|حي|زقاق) (?:[\p{Arabic}\p{M}]+ ){1,4}رقم \d+(?:، ?[\p{Arabic}\p{M}]+)?"),
        ]
        self.streets = [(flag(p.replace("TOWN", town)) if flag is c else regex.compile(p.replace("TOWN", f"(?-i:{town})"), regex.V1 | regex.I), flag(p.replace("TOWN", loose_town))) for flag, p in self.streets]
        self.common = frozenset("a an the very so not from at in on of and happy sorry glad still just also here very new der die das ein eine le la les un une el los las o os um uma".split())
        self.thai_name = c(r"\s?([\p{Thai}\p{M}]{2,14} (?:(?!และ|เป็น|ค่ะ|ครับ|นะคะ|นะครับ|เลยครับ|จริงๆ|ที่)[\p{Thai}\p{M}])+)")
        self.han = c(r"[\p{Han}ヶ々]{2,4}?(?=[，。！？,.!?、；;\s]|$)")
        self.ja_before = c(r"[\p{Han}\p{Katakana}\p{Hiragana}ヶ々]+$")
        self.ja_after = c(r"([\p{Han}ヶ々\p{Katakana}\p{Hiragana}]{2,10}?)(?=さん|様|氏)")
        self.arabic = c(r"\s?([\p{Arabic}--[،؛؟]]+ (?!و)[\p{Arabic}--[،؛؟]]+)")
        self.hindi = c(r"\s?([\p{Devanagari}]+ [\p{Devanagari}]+)")

    def shadow(self, text: str) -> tuple[str, list[int]]:
        """The text without disguise, and where each of its signs stands in the text."""
        kept = [k for k, s in enumerate(text) if s not in INVISIBLE_SET and not (k and s in _BLANKS and text[k - 1] in _BLANKS)]
        plain = "".join(_WIDTH.get(text[k], text[k]) for k in kept)
        return self.rewriter.words(plain), [*kept, len(text)]

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of each piece, without overlaps."""
        plain, at = self.shadow(text)
        low = plain.lower()
        if len(low) != len(plain):
            low = "".join(s.lower() if len(s.lower()) == 1 else s for s in plain)
        pieces: list[tuple[int, int, str]] = []
        pages: list[tuple[int, int]] = []
        for end, (kinds, cue) in self.automaton.iter(low):
            if SCHEME in kinds:
                pages.append(self._page(plain, end + 1))
                continue
            around = plain[max(0, end - 30) : end + 60]
            cased = around != around.lower() and around != around.upper()
            for kind in kinds:
                pieces += [(a, b, _KIND.get(kind, kind)) for a, b in self._expand(kind, cue, plain, low, end + 1 - len(cue), end + 1, cased) if b > a]
        # Emails and addresses hold names and numbers of their own; longer pieces come first.
        order = {EMAIL: 0, ADDRESS: 1, IDENTITY: 2, PHONE: 3, NAME: 4}
        taken: list[tuple[int, int, str]] = []  # sorted, without overlaps
        for a, b, kind in sorted(set(pieces), key=lambda p: (order[p[2]], p[0] - p[1], p[0])):
            if kind in (IDENTITY, PHONE) and any(x <= a and b <= y for x, y in pages):
                continue
            k = bisect_left(taken, (a, b, kind))
            if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
                taken.insert(k, (a, b, kind))
        return [(at[a], at[b - 1] + 1, kind) for a, b, kind in taken]

    @staticmethod
    def _page(plain: str, at: int) -> tuple[int, int]:
        """The address of a page around a scheme: numbers in it are none of a person."""
        a = b = at
        while a and not plain[a - 1].isspace():
            a -= 1
        while b < len(plain) and not plain[b].isspace():
            b += 1
        return a, b

    @staticmethod
    def _first(pattern, plain: str, b: int, within: int, begins: Callable[[str], bool]):
        """The first match that begins at most so far after b, however long it is."""
        for k in range(b, min(b + within + 1, len(plain))):
            if begins(plain[k]) and (m := pattern.match(plain, k)):
                return m
        return None

    def _expand(self, kind: str, cue: str, plain: str, low: str, a: int, b: int, cased: bool) -> Iterator[tuple[int, int]]:
        if kind == EMAIL:
            yield from self._email(cue, plain, a, b)
        elif kind == PHONE:
            m = self._first(self.phone, plain, b, 2 if cue == "मुझे" else 14, lambda s: s in "+(" or s.isdigit())
            if m and not any(x.isdigit() for x in plain[b : m.start()]) and 7 <= sum(x.isdigit() for x in m[0]) <= 20:
                if not any(cue in low[b : m.start()] for cue in IDENTITY_CUES):
                    yield m.span()
        elif kind == DIRECT:
            m = self._first(self.phone, plain, b, 4, lambda s: s in "+(" or s.isdigit())
            if m and not any(x.isalnum() for x in plain[b : m.start()]) and 7 <= sum(x.isdigit() for x in m[0]) <= 20:
                yield m.span()
        elif kind == PREFIX:
            if a and (plain[a - 1].isalnum() or plain[a - 1] in ".,-/+"):
                return
            m = self.phone.match(plain, a)
            digits = "".join(x for x in m[0] if x.isdigit()) if m else ""
            number = digits[2:] if cue == "00" else digits
            if number[:1] not in ("", "0") and (10 if cue == "00" else 8) <= len(number) <= 17:
                yield m.span()
        elif kind == IDENTITY:
            m = self._first(self.identity, plain, b, 16, str.isalnum)
            digits = [x for x in m[0] if x.isdigit()] if m else []
            if len(digits) >= 6 and len(set(digits)) > 1:
                yield m.span()
        elif kind == CHECKED:
            for pattern, valid in ((self.iban, is_account), (self.card, is_card)):
                m = self._first(pattern, plain, b, 16, str.isalnum)
                # Words may follow an account number: it ends where what is before the end is valid.
                ends = [m.end(), *(m.start() + k for k in range(len(m[0]) - 1, 0, -1) if m[0][k] == " ")] if m else []
                if end := next((e for e in ends if valid(plain[m.start() : e])), None):
                    yield m.start(), end
                    return
        elif kind == ADDRESS:
            for strict, loose in self.streets:
                yield from self._around(strict if cased else loose, plain, a, b)
        else:
            yield from self._name(cue, plain, low, a, b, cased)

    @staticmethod
    def _around(pattern, plain: str, a: int, b: int) -> Iterator[tuple[int, int]]:
        """What matches around a cue; the stretch that is looked into holds so many words, and grows for as long as a match reaches its ends."""
        left, right = a, b
        for _ in range(9):
            left = max(plain.rfind(" ", 0, max(left - 1, 0)), 0)
        for _ in range(14):
            right = plain.find(" ", right + 1) if right < len(plain) else right
            right = len(plain) if right < 0 else right
        before, after = max(60, a - left), max(90, right - b)
        while True:
            start, stop = max(0, a - before), min(len(plain), b + after)
            found = [m.span() for m in pattern.finditer(plain, start, stop) if m.start() <= b + 1 and m.end() >= a]
            if not any((x == start and start) or (y == stop and stop < len(plain)) for x, y in found):
                yield from found
                return
            before, after = 2 * before, 2 * after

    def _email(self, cue: str, plain: str, a: int, b: int) -> Iterator[tuple[int, int]]:
        stop = a - 1 if a and plain[a - 1] == " " else a
        start = stop
        while start and plain[start - 1] in self.local_signs:
            start -= 1
        before = self.local.search(plain[start:stop])
        after = self.domain.match(plain, b)
        if not before or not after:
            return
        labels = [m.span() for m in self.label.finditer(after[1])]
        if cue == " at " and not any(after[1][x:y] != "." for x, y in labels):
            return
        end, shift = after.end(), after.start(1)
        for x, y in labels:  # a capital after a full stop begins the next sentence
            if after[1][y : y + 1].isupper() and after[1][x - 1 : x].islower():
                end = shift + x
                break
        domain = plain[shift:end]
        if self.label.search(domain) and self.label.split(domain)[-1].isalpha() and len(self.label.split(domain)[-1]) > 1:
            yield start + before.start(), end

    def _is_name(self, words: str) -> bool:
        """Two or three words, none of which a text like this would write in capitals anyway."""
        return 2 <= len(words.split(" ")) <= 3 and not any(w in self.common for w in words.lower().split(" "))

    def _name(self, cue: str, plain: str, low: str, a: int, b: int, cased: bool) -> Iterator[tuple[int, int]]:
        if a and cue[0].isalpha() and low[a - 1].isalpha() and ord(cue[0]) < 0x0E00:
            return
        if cue == "と申します":
            m = self.ja_before.search(plain, max(0, a - 10), a)
        elif cue == "担当は":
            m = self.ja_after.match(plain, b)
        elif cue in ("我叫", "我是", "经办人是"):
            m = self.han.match(plain, b)
        elif cue == "คุณ" or cue == "ชื่อ":
            m = self.thai_name.match(plain, b + 3 if plain[b : b + 3] == "คุณ" else b)
            m = m if m and (cue == "คุณ" and plain[max(0, a - 3) : a] in ("คือ", "ชื่อ"[-3:]) or cue == "ชื่อ" and plain[max(0, a - 4) : a].endswith(("ฉัน", "ผม"))) else None
        elif cue in ("اسمي", "والمسؤول هو", "السيد "):
            m = self.arabic.match(plain, b)
        elif cue == "मेरा नाम":
            m = self.hindi.match(plain, b)
        elif cue == " जी ":
            words = plain[max(0, a - 60) : a].replace(",", " , ").split(" ")[-2:]
            start = a - len(" ".join(words))
            if len(words) == 2 and plain[start:a] == " ".join(words) and all(w and "ऀ" <= w[0] <= "ॿ" for w in words):
                yield start, a
            return
        elif cue == " at the desk":
            m = next((x for x in (self.name if cased else self.loose_name).finditer(plain, max(0, a - 200), a) if x.end() == a), None)
        else:
            start = b + len(plain[b:]) - len(plain[b:].lstrip(" "))
            if cue in LOOSE_NAME_CUES:
                m = self.name.match(plain, start) if cased else None
                if m and self._is_name(m[0]):
                    yield m.span()
                return
            if cue in ("m. ", "mr ", "contact ", "ask for ", "thanks, ", "sr. ") and not cased:
                if cue not in ("thanks, ", "contact ", "sr. ") or low[start : start + 3] in ("mrs", "mr.", "ms."):
                    return
            m = (self.name if cased else self.loose_name).match(plain, start)
            if m and cue in ("contact ", "thanks, ") and plain[m.end() : m.end() + 1] not in (" ", ","):
                m = None
        if m:
            yield m.span(1) if m.re.groups else m.span()


def is_card(number: str) -> bool:
    """Whether the digits of a card number have the right sum, every second one doubled."""
    digits = [int(x) for x in number if x.isdigit()]
    return len(set(digits)) > 1 and sum(sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits))) % 10 == 0


def is_account(number: str) -> bool:
    """Whether an account number's remainder by 97 is 1, its first four signs moved to the end and letters read as numbers."""
    signs = number.replace(" ", "").upper()
    return 15 <= len(signs) <= 34 and signs.isascii() and int("".join(str(int(x, 36)) for x in signs[4:] + signs[:4])) % 97 == 1


INVISIBLE_SET = frozenset(INVISIBLE)


def redact(text: str, pieces: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder for each piece and unchanged elsewhere."""
    out, done = [], 0
    for a, b, kind in pieces:
        out += [text[done:a], f"[{kind.upper()}]"]
        done = b
    return "".join([*out, text[done:]])


def personal_data(rows: DataFrame, key: str) -> DataFrame:
    """(key, pieces, redacted) of each row, which has key and `text`.

    Null texts come out with no pieces and a null redaction. Equal keys are equal rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Finder()
        kind = pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32()), ("pii_kind", pa.string())]))
        names = ("start_char", "end_char", "pii_kind")
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [tool.find(t) if t else [] for t in texts]
            redacted = [redact(t, p) if p else t for t, p in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([[dict(zip(names, p)) for p in x] for x in found], kind), pa.array(redacted, pa.string())], [key, "pieces", "redacted"])

    kept = rows.select(key, "text")
    return kept.mapInArrow(run, f"`{key}` {kept.schema[key].dataType.simpleString()}, pieces array<struct<start_char: int, end_char: int, pii_kind: string>>, redacted string")
