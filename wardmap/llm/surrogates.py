"""Personal data: detected entities are replaced by keyed surrogates of the same type and format.

An entity is made of atoms, such as an address, a number, a given name or a surname. An atom's surrogate is a
keyed function of its kind and normal form, so it is the same in every text (coreference) and nothing but the key
is stored. Surrogates keep script, letter case, length of numbers, country code, gender of given names and valid
check digits. A given name has one gender in the whole corpus, that of its list or else of most of its titles. All
atoms of the corpus are then checked, names of all kinds together: where two atoms got the same surrogate, or a
surrogate is itself an atom of the corpus, the later ones draw again until all differ (distinctness); every kind has
more values the more often it draws. Addresses of hosts are permuted within their network instead, so they differ
without drawing. The few that drew again, or whose title tells another gender, are joined to the documents that hold them.

A title makes the words after it a name. A known given name alone does not ("Max Temperature", "Grace Period"): the word
after it has to be a surname. That is decided by how the whole corpus writes the word, in lower case or after an
article, or as a name; and where it stands nowhere else, by a classifier of words, fitted on the letters of surnames and
common nouns. Words that are judged otherwise by the corpus than by the classifier are joined to their documents.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
import secrets
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardmap.llm.arrays import ALPHANUMERIC, LOWERED, Texts, find_spans, small_batches, span_hashes, text_slices
from wardmap.llm.keys import ROW_HASH, ROW_ID, bitmap_of, in_bitmap, join_rows, keyed
from wardmap.llm.logistic import Sparse, fit, margins, probabilities
from wardmap.session import stored

# Titles and given names that tell a gender, by script.
TITLES = {
    "m": "Mr Herr Monsieur Señor Sr Don господин г-н".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Doña госпожа г-жа".split(),
    "": "Dr Prof".split(),
}
GIVEN = {
    ("latin", "m"): "Adam Albert Anton Carl Daniel David Edward Felix Frank George Hans Henry Hugo Ivan Jack James John "
                    "Jorge Juan Karl Leo Louis Luis Martin Max Michael Oscar Otto Paul Peter Pierre Robert Samuel Simon "
                    "Thomas Victor Walter William Aaron Alan Alexander Andrew André Andreas Arthur Benjamin Brian "
                    "Charles Christopher Dennis Donald Eric Ernst Franz Georg Günter Heinz Ian Jacob Jason Jean Jonathan "
                    "José Joseph Joshua Jürgen Kevin Klaus Kurt Lukas Marco Mark Matthew Nicholas Noah Patrick Philip "
                    "Richard Roger Sebastian Stefan Stephen Steven Tobias Vincent Werner Wolfgang".split(),
    ("latin", "f"): "Alice Amelia Ana Anna Carla Carmen Charlotte Clara Diana Elena Elise Ella Emily Emma Eva Grace "
                    "Greta Hannah Helen Ida Irene Jane Julia Karin Laura Lena Lisa Lucy Maria Marie Martha Mary Nina "
                    "Nora Olivia Paula Rosa Sarah Sofia Vera Amanda Amy Andrea Angela Anne Barbara Birgit Caroline "
                    "Catherine Chloe Chloé Christine Claudia Deborah Dorothy Elizabeth Erika Esther Gabriele Heidi "
                    "Helga Ingrid Isabel Jennifer Jessica Judith Karen Katharina Linda Lucia Margaret Melissa Michelle "
                    "Monika Nancy Natalie Nicole Patricia Petra Rachel Rebecca Renate Ruth Sabine Sandra Silvia Sophie "
                    "Susan Teresa Ursula Yvonne Zoe Zoë".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Николай Олег Павел Пётр Сергей Юрий".split(),
    ("cyrillic", "f"): "Анна Вера Галина Елена Ирина Мария Нина Ольга Светлана Татьяна Юлия".split(),
}
# Surnames and common nouns whose letters tell them apart; articles.
SURNAMES = (
    "smith jones brown taylor wilson johnson walker wright thompson robinson harris clarke lewis jackson turner hughes "
    "edwards collins stewart morris murphy bailey cooper richardson marshall anderson simpson müller schmidt schneider "
    "fischer weber meyer wagner becker schulz hoffmann schäfer koch bauer richter klein schröder neumann schwarz "
    "zimmermann braun krüger hartmann lange werner krause lehmann martin bernard dubois thomas robert petit durand leroy "
    "moreau laurent simon lefebvre michel garcia rodriguez gonzalez fernandez lopez martinez sanchez perez gomez ruiz "
    "hernandez jimenez diaz alvarez moreno muñoz romero rossi russo ferrari esposito bianchi romano colombo ricci marino "
    "greco conti costa nowak kowalski wisniewski novak svoboda horvath nagy petrov larsen hansen nielsen jensen olsen "
    "johansson andersson lindberg janssen bakker visser jansen mensah owusu okafor kravitz steiner huber mayer").split()
NOUNS = (
    "temperature period discussion street road avenue lane square value values speed weight height length width size load "
    "power rate time times day days week month year note notes letter letters office school college university hospital "
    "clinic church bay island islands river lake mountain park bridge house hall center centre station airport award prize "
    "foundation institute group company band album song film movie show series book books club team cup league game test "
    "model method theorem equation function law rule effect number index factor limit level line point order process "
    "system setting settings option options question answer opinion statement review report article edition version "
    "pressure distance duration capacity volume amount price cost budget account standard review language program "
    "project service engine sensor voltage current output input error").split()
ARTICLES = "the a an der die das den dem des ein eine le la les un une el los las una il lo gli".split()
GENDER = {name.lower(): (script, gender) for (script, gender), names in GIVEN.items() for name in names}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя",
           "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αειου"}

_marks = "".join(c for c in map(chr, range(0x300, 0x110000)) if unicodedata.category(c) in ("Mn", "Mc"))
_letters = rf"[^\W\d_](?:[^\W\d_]|[{_marks}])*"
_word = rf"{_letters}(?:[-'’]{_letters})*"
_titles = "|".join(re.escape(t) for ts in TITLES.values() for t in ts)
_names = "|".join(n for ns in GIVEN.values() for n in ns)
_octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: In order of precedence where two would overlap from the same place on.
PATTERNS = [
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")),
    ("token", re.compile(
        r"""(?i)\b(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth[_-]?key)\b["']?\s*[=:]\s*["']?"""
        r"""(?P<value>[\w+/=~.-]{8,})""")),
    ("token", re.compile(r"(?<!\w)(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{36}|sk-[\w-]{20,}|xox[abprs]-[\w-]{10,})(?!\w)")),
    ("token", re.compile(r"(?i)(?<!\w)(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?!\w)")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")),
    ("ip", re.compile(rf"(?<![\w.]){_octet}(?:\.{_octet}){{3}}(?!\w|\.\d)")),
    ("ip6", re.compile(r"(?i)(?<![\w:.])(?=[0-9a-f:]*:[0-9a-f:]*:)[0-9a-f:]{3,39}(?![\w:]|\.\d)")),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,5}){2,4}(?!\w)")),
    ("phone", re.compile(r"(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)")),
    ("phone", re.compile(r"(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.-])(?<!\d )\d{3} \d{3} \d{4}(?![\w-]| ?\d)")),
    ("phone", re.compile(r"(?<![\w.,+-])(?<!\d )\(?0[1-9]\d{1,3}\)?[ /-]\d{3,5}(?:[ -]?\d{2,5})?(?![\w-]| ?\d|[.,]\d)")),
    ("ssn", re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")),
    ("card", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])")),
    ("name", re.compile(rf"\b(?P<title>{_titles})\b\.?[ \t]+(?P<value>{_word}(?:[ \t]+{_word}){{0,2}})")),
    ("name", re.compile(rf"\b(?P<value>(?:{_names})[ \t]+{_word})")),
]
DIGIT = re.compile(r"\d")
#: Beginnings and lengths of the numbers that card issuers give out.
ISSUED = re.compile(
    r"(?:4\d{12}(?:\d{3})?(?:\d{3})?|(?:5[0-8]|6\d|2[2-7])\d{14}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11}"
    r"|352[89]\d{12}|35[3-8]\d{13}|6\d{18})\Z")
WORD, LETTERS_OF = re.compile(_word), re.compile(_letters)


def _class(characters: str) -> str:
    """A class of RE2 with runs of characters."""
    runs: list[list[int]] = []
    for c in map(ord, characters):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + "]"


def _re2_word(word: str) -> str:
    r"""A word as RE2 finds it wherever ``\b`` stands before it; RE2's own knows ASCII only."""
    return (r"\b" if word[0].isascii() else "") + re.escape(word)


_beyond = r"[^\x00-\x7f]"
_space = rf"(?:[\s\x0b\x1c-\x1f]|{_beyond})*"
#: For RE2: matches wherever one of the patterns does, and in some other texts. Words are looked for with the signs
#: that must follow them; what stands before or after may be any sign, in ASCII or not.
TRIGGERS = "|".join([
    "@", _class("".join(c for c in map(chr, range(0x110000)) if DIGIT.match(c))),
    rf"(?i:(?:token|secret|passw(?:or)?d|pwd|ap[iİı][_-]?key|access[_-]?key|auth[_-]?key)[\"']?{_space}[=:])",
    rf"AKIA[A-Z]{{16}}|gh[pousr]_|sk-(?:[\w-]|{_beyond}){{20}}|xox[abprs]-|(?i:[a-f]{{32}})",
    "(?:" + "|".join(_re2_word(t) for ts in TITLES.values() for t in ts) + r")\.?[ \t]",
    "(?:" + "|".join(_re2_word(n) for ns in GIVEN.values() for n in ns) + r")[ \t]",
])


def readable(column: pa.Array) -> list[str | None]:
    """The texts of a column that can hold an entity, None for the others; the patterns are slow, RE2 is not."""
    use = pc.match_substring_regex(column.cast(pa.large_string()), TRIGGERS).to_pylist()
    return [text.as_py() if used else None for text, used in zip(column, use, strict=True)]


def decimal(text: str) -> str:
    """Digits of any script as ASCII ones."""
    return text if text.isascii() else DIGIT.sub(lambda m: str(int(m[0])), text)


def digits_like(text: str, new: str) -> str:
    """ASCII digits in the script of a text's first digit."""
    first = DIGIT.search(text)
    zero = ord(first[0]) - int(first[0]) if first else ord("0")
    return new if zero == ord("0") else "".join(chr(zero + int(c)) if c in "0123456789" else c for c in new)


def luhn(digits: str) -> bool:
    total = sum(int(d) * 2 - 9 * (d > "4") if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def iban_check(text: str) -> int:
    """The remainder that makes an account number valid: 1."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def normal(kind: str, text: str) -> str | None:
    """The normal form of a value; None if it is not of the kind after all."""
    if kind == "email":
        return text.lower()
    if kind in ("card", "phone", "ssn", "iban", "ip"):
        text = decimal(text)
    if kind == "card":
        digits = "".join(DIGIT.findall(text))
        return digits if luhn(digits) and len(set(digits)) > 1 and ISSUED.match(digits) else None
    if kind == "ip6":
        try:
            address = ipaddress.IPv6Address(text)
        except ValueError:
            return None
        # Words of hexadecimal letters around two colons are no addresses.
        return str(address) if len(text.replace(":", "")) > 4 and any(c.isdigit() for c in text) else None
    if kind == "phone":
        digits = "".join(DIGIT.findall(text))
        code = re.match(r"\+(\d{1,3})(?!\d)", text)
        country = code[1] if code else digits[:1] if text[0] == "+" else ""
        return f"{country} {digits[len(country):]}" if 7 <= len(digits) <= 15 else None
    if kind == "ssn":
        return text
    if kind == "iban":
        bare = text.replace(" ", "")
        return bare if 15 <= len(bare) <= 34 and iban_check(bare) == 1 else None
    return text


Verdicts = dict[str, bool]


def atoms(text: str, verdicts: Verdicts | None = None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the atoms of a text, in order and without overlap.

    ``verdicts`` tells of words after a given name without a title whether they are common words; of others the
    classifier does.
    """
    found, spreading = [], set()
    digits = DIGIT.search(text) is not None
    for rank, (kind, pattern) in enumerate(PATTERNS):
        if kind == "email" and "@" not in text or kind in ("iban", "ip", "phone", "ssn", "card") and not digits:
            continue
        for m in pattern.finditer(text):
            if kind == "name":
                titled = "title" in pattern.groupindex
                parts = name_atoms(m, verdicts or {})
                found += [(s, rank, e, k, n) for s, e, k, n in parts]
                # A given name that may be a word spreads from a title only.
                spreading.update((k, n) for _, _, k, n in parts if titled or k == "surname")
                continue
            group = "value" if "value" in pattern.groupindex else 0
            value = normal(kind, m[group])
            if value is not None:
                found.append((m.start(group), rank, m.end(group), kind, value))
    kept = apart(found)
    repeats = bare_names(text, [a for a in kept if a[2:] in spreading])
    return apart([*found, *repeats]) if repeats else kept


def apart(found: list[tuple[int, int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The first of those that overlap, by place and rank."""
    kept, end = [], 0
    for s, _, e, kind, value in sorted(found):
        if s >= end:
            kept.append((s, e, kind, value))
            end = e
    return kept


#: Surnames that are declined: the stem, which is the name's normal form, and its endings.
DECLINED = re.compile("(.{2,}(?:ов|ев|ёв|ин|ын))(а|у|ой|ою|ым|ом|е|ы|ых|ыми)?$", re.S)
ENDINGS = ("", "а", "у", "ой", "ою", "ым", "ом", "е", "ы", "ых", "ыми")


def stem(word: str) -> str:
    """The part of a surname that all its forms share."""
    found = DECLINED.match(word.lower())
    return word[:len(found[1])] if found else word


def bare_names(text: str, kept: list[tuple[int, int, str, str]]) -> list[tuple[int, int, int, str, str]]:
    """Names of a text wherever else they stand in it, without title or given name, declined ones in all forms.

    They are found as written, in capitals and with a capital. A word that the text has more often in lower case
    than so is no name. A word that is both is a surname.
    """
    forms: dict[str, tuple[str, str, int]] = {}
    for s, e, kind, value in sorted(kept, key=lambda a: a[2] == "surname"):
        if (kind == "surname" or kind.startswith("given")) and e - s > 1:
            endings = ENDINGS if kind == "surname" and DECLINED.match(value) else ("",)
            for written_as in (text[s:e], text[s:e].upper(), text[s:e].title()):
                upper = written_as.isupper() and len(written_as) > 1
                forms |= {written_as + (x.upper() if upper else x): (kind, value, e - s) for x in endings}
    if not forms:
        return []
    lower = {value for _, value, _ in forms.values()}
    out, balance = [], Counter()
    for w in WORD.finditer(text):
        parts = [w] if w[0] in forms or w[0] in lower else LETTERS_OF.finditer(text, w.start(), w.end())
        for part in parts:
            if part[0] in forms:
                kind, value, size = forms[part[0]]
                out.append((part.start(), len(PATTERNS), part.start() + size, kind, value))
                balance[value] += 1
            elif part[0] in lower:
                balance[part[0]] -= 1
    return [a for a in out if balance[a[4]] >= 0]


#: Scripts that write a name as one word, and the characters such a name has at most.
ONE_WORD = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff]")
LONGEST = 4


def name_words(m: re.Match) -> list[tuple[int, int, str]]:
    """The words of a match that can be a name: no words in lower case, and one only in scripts that write it so."""
    words = []
    for w in re.finditer(_word, m["value"]):
        word, start = re.sub("['’][sS]$", "", w[0]), m.start("value") + w.start()
        if ONE_WORD.match(word):
            if not words:
                # Longer runs go on with what the person does.
                size = len(word) if len(word) <= LONGEST else LONGEST - 1
                words.append((start, start + size, word[:size]))
            break
        if word[0].islower():
            break
        words.append((start, start + len(word), word))
    return words


def name_atoms(m: re.Match, verdicts: Verdicts) -> list[tuple[int, int, str, str]]:
    """Given names and surname after a title, or a known given name and a surname."""
    title = m.groupdict().get("title")
    gender = next((g for g, ts in TITLES.items() if title in ts), "")
    words = name_words(m)
    if not words or not title and (len(words) < 2 or is_common(words[-1][2], verdicts)):
        return []
    out = []
    for i, (s, e, word) in enumerate(words):
        if i < len(words) - 1 or word.lower() in GENDER and not title:
            own = GENDER.get(word.lower(), (script_of(word), ""))[1] or gender
            out.append((s, e, f"given-{own}", word.lower()))
        else:
            bare = stem(word)
            out.append((s, s + len(bare), "surname", bare.lower()))
    return out


def untitled(text: str) -> set[str]:
    """The words after given names without a title, in lower case."""
    return {words[-1][2].lower() for m in PATTERNS[-1][1].finditer(text) if len(words := name_words(m)) > 1}


WORD_FEATURES = 1 << 12
_FITTED: list[tuple[np.ndarray, float]] = []


def word_features(words: list[str]) -> Sparse:
    """Runs of two to four characters of words, their ends marked, and the words as wholes."""
    columns = []
    for word in words:
        marked = f"^{word.lower()}$"
        grams = {marked} | {marked[i:i + n] for n in (2, 3, 4) for i in range(len(marked) - n + 1)}
        columns.append(sorted({zlib.crc32(g.encode()) % WORD_FEATURES for g in grams}))
    sizes = [len(c) for c in columns]
    values = np.concatenate([np.full(n, n ** -0.5) for n in sizes])
    return Sparse(np.concatenate(columns).astype(np.int64), values, np.concatenate([[0], np.cumsum(sizes)]))


def noun_chance(word: str) -> float:
    """Probability that a word is a common noun rather than a surname, by its letters."""
    if not _FITTED:
        y = np.array([0] * len(SURNAMES) + [1] * len(NOUNS))
        _FITTED.append(fit(word_features(SURNAMES + NOUNS), y, WORD_FEATURES))
    return float(probabilities(margins(word_features([word]), *_FITTED[0]))[0])


def is_common(word: str, verdicts: Verdicts) -> bool:
    """Whether the word after a given name is a common one."""
    lowered = word.lower()
    return verdicts[lowered] if lowered in verdicts else script_of(word) == "latin" and noun_chance(lowered) > 0.5


def script_of(text: str) -> str:
    for c in text.lower():
        for script, letters in LETTERS.items():
            if c in letters:
                return script
    return "latin"


def draws(key: bytes, kind: str, value: str, attempt: int) -> Callable[[int], int]:
    """A keyed stream of numbers below a bound."""
    state = {"n": 0, "bytes": b""}

    def below(n: int) -> int:
        if len(state["bytes"]) < 4:
            text = f"{kind}\x00{value}\x00{attempt}\x00{state['n']}".encode()
            state["bytes"] += hashlib.blake2b(text, key=key[:64]).digest()
            state["n"] += 1
        number, state["bytes"] = int.from_bytes(state["bytes"][:4], "big"), state["bytes"][4:]
        return number % n

    return below


def like(text: str, below: Callable[[int], int]) -> str:
    """Letters and digits replaced by others of the same script and kind."""
    out = []
    for c in text:
        if c.isdigit() and c.isascii():
            out.append("0123456789"[below(10)])
        elif c.isalpha():
            letters = LETTERS[script_of(c)]
            new = letters[below(len(letters))]
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The replacement of an atom, in normal form."""
    below = draws(key, kind, value, attempt)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        head, _, top = domain.rpartition(".")
        # Where a corpus holds most addresses of a length, a letter more after some draws.
        longer = like(local + "x" * (attempt // 16), below)
        return f"{longer}@{like(head, draws(key, 'domain', domain, 0))}.{top}"
    if kind == "ip":
        return str(ipaddress.IPv4Address(permuted_host(key, int(ipaddress.IPv4Address(value)))))
    if kind == "ip6":
        number = int(ipaddress.IPv6Address(value))
        return str(ipaddress.IPv6Address(number >> 112 << 112 | permuted(key, "ip6", number % (1 << 112), 112)))
    if kind == "phone":
        country, _, rest = value.partition(" ")
        # Where a corpus holds most numbers of a length, a digit more after some draws.
        return f"{country} " + "".join(str(below(10)) for _ in range(len(rest) + attempt // 16))
    if kind == "card":
        body = value[0] + "".join(str(below(10)) for _ in value[1:-1])
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "ssn":
        return f"{1 + below(665):03d}-{1 + below(99):02d}-{1 + below(9999):04d}"
    if kind == "iban":
        rest = like(value[4:].lower(), below).upper()
        return f"{value[:2]}{98 - iban_check(value[:2] + '00' + rest):02d}{rest}"
    if kind == "token":
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
            hexes = "0123456789abcdef" if value == value.lower() else "0123456789ABCDEF"
            return "".join(hexes[below(16)] for _ in value)
        return like(value, below)
    script = script_of(value)
    if any(unicodedata.category(c) == "Lo" for c in value):
        longer = value + next(c for c in value if unicodedata.category(c) == "Lo") * (attempt // 8)
        return "".join(caseless(c, below) for c in longer)
    if kind.startswith("given"):
        names = GIVEN.get((script, kind[6:])) or [n for (s, _), ns in GIVEN.items() if s == script for n in ns]
        names = [n for n in names if n.lower() != value] or [like(value, below)]
        name = names[below(len(names))].lower()
        # Beyond the first draws a double name, of which there are more.
        return name if attempt < 4 else f"{name}-{syllables(script, below, 2 + attempt // 8)}"
    declined = DECLINED.match(value)
    new = syllables(script, below, max(2, min(4, len(value) // 2)) + attempt // 8)
    return new[:-1] + declined[1][-2:] if declined else new


#: Networks whose addresses stay within them: first address and bits of the host.
NETWORKS = [(int(ipaddress.IPv4Address(a)), bits) for a, bits in (
    ("0.0.0.0", 24), ("10.0.0.0", 24), ("127.0.0.0", 24), ("169.254.0.0", 16), ("172.16.0.0", 20), ("192.168.0.0", 16),
    ("224.0.0.0", 28), ("240.0.0.0", 28))]


def permuted_host(key: bytes, number: int) -> int:
    """The address that takes the place of another: a permutation of each network, and of all public addresses."""
    network = lambda n: next(((first, bits) for first, bits in NETWORKS if n >> bits == first >> bits), None)
    if own := network(number):
        first, bits = own
        return first | permuted(key, f"ip {first}", number - first, bits)
    number = permuted(key, "ip", number, 32)
    while network(number):
        number = permuted(key, "ip", number, 32)
    return number


def permuted(key: bytes, label: str, number: int, bits: int) -> int:
    """A keyed permutation of the numbers of an even number of bits: a Feistel network of six rounds."""
    half = bits // 2
    left, right = number >> half, number & ((1 << half) - 1)
    for turn in range(6):
        text = f"{label}\x00{turn}\x00{right}".encode()
        mixed = int.from_bytes(hashlib.blake2b(text, key=key[:64]).digest()[:16], "big") & ((1 << half) - 1)
        left, right = right, left ^ mixed
    return left << half | right


def caseless(c: str, below: Callable[[int], int]) -> str:
    """A letter without case is replaced by one near it, of the same script."""
    near = letters_near(ord(c) >> 6) if unicodedata.category(c) == "Lo" else c
    return near[below(len(near))]


@functools.cache
def letters_near(block: int) -> str:
    return "".join(c for c in map(chr, range(block << 6, block + 1 << 6)) if unicodedata.category(c) == "Lo")


def syllables(script: str, below: Callable[[int], int], n: int) -> str:
    vowels = VOWELS[script]
    others = [c for c in LETTERS[script] if c not in vowels]
    return "".join(others[below(len(others))] + vowels[below(len(vowels))] for _ in range(n))


def written(kind: str, text: str, new: str) -> str:
    """A surrogate in the format of the text that it replaces."""
    if kind in ("phone", "card", "iban", "ip", "ssn"):
        new = digits_like(text, new)
    if kind in ("phone", "card", "iban"):
        bare = iter(new.replace(" ", ""))
        return "".join([next(bare) if c.isalnum() else c for c in text]) + "".join(bare)
    if kind == "ip6" and "::" not in text:
        groups = ipaddress.IPv6Address(new).exploded.split(":")
        new = ":".join(g if len(t) == 4 else f"{int(g, 16):x}" for g, t in zip(groups, text.split(":"), strict=True))
    if kind == "ip6":
        return new.upper() if text.isupper() else new
    if kind in ("token", "ip", "ssn"):
        return new
    if text.isupper() and len(text) > 1:
        return new.upper()
    if kind == "email":
        return "".join(n.upper() if c.isupper() else n for c, n in zip(text, new, strict=False))
    return "-".join(p[:1].upper() + p[1:] for p in new.split("-")) if text[:1].isupper() else new


def scrub(
    text: str, key: bytes, redrawn: dict[tuple[str, str], str], verdicts: Verdicts | None = None,
) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds of its atoms."""
    out, at, kinds = [], 0, []
    for start, end, kind, value in atoms(text, verdicts):
        new = redrawn.get((kind, value)) or surrogate(key, kind, value)
        out += [text[at:start], written(kind, text[start:end], new)]
        kinds.append(kind)
        at = end
    return "".join([*out, text[at:]]), kinds


def corpus_atoms(texts: DataFrame) -> DataFrame:
    """(row key, kind, value) of the atoms of every text, each once per text.

    ``texts`` is as from ``keyed``, with ``verdicts``, a list of (word, common). Words after given names without a title
    have the kinds ``untitled-0`` and ``untitled-1`` (common by the classifier) besides.
    """
    fields = texts.select(ROW_ID, ROW_HASH).schema

    def run(batches):
        for batch in (small for whole in batches for small in small_batches(whole)):
            rows, kinds, values = [], [], []
            known = batch.column("verdicts").to_pylist()
            for i, (text, told) in enumerate(zip(readable(batch.column("__text")), known, strict=True)):
                if not text:
                    continue
                every = {a[2:] for a in atoms(text, {v["value"]: v["common"] for v in told or ()})}
                every |= {(f"untitled-{int(is_common(w, {}))}", w) for w in untitled(text)}
                for kind, value in sorted(every):
                    rows.append(i)
                    kinds.append(kind)
                    values.append(value)
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW_ID).take(rows), batch.column(ROW_HASH).take(rows), pa.array(kinds, pa.string()),
                 pa.array(values, pa.string())], [ROW_ID, ROW_HASH, "kind", "value"])

    return texts.mapInArrow(
        run, f"{ROW_ID} {fields[ROW_ID].dataType.simpleString()}, {ROW_HASH} bigint, kind string, value string")


def word_hashes(values: list[str]) -> np.ndarray:
    """Hashes of single words, as of the words of texts with A-Z folded."""
    data = [v.encode() for v in values]
    ends = np.cumsum([0, *map(len, data)])
    texts = Texts(np.frombuffer(b"".join(data), np.uint8), ends)
    return span_hashes(texts, find_spans(texts, np.ones(256, bool)), LOWERED)


def written_as(docs: DataFrame, text_column: str, words: DataFrame, bits: int = 22) -> DataFrame:
    """(hash, common, proper): how often the corpus writes words (hash) as common words and as names.

    In lower case or after an article they are common; with a capital after neither an article nor a given name, proper.
    The words reach the tasks as a bitmap of fixed size; a row for each word and batch leaves them.
    """
    bitmap = bitmap_of(words, "hash", bits)
    articles = np.sort(word_hashes(ARTICLES))
    given = np.sort(word_hashes(sorted({n.lower() for ns in GIVEN.values() for n in ns if n.isascii()})))

    def run(batches):
        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                spans = find_spans(texts, ALPHANUMERIC)
                hashes = span_hashes(texts, spans, LOWERED)
                at = np.flatnonzero(in_bitmap(bitmap, hashes))
                if not len(at):
                    continue
                first = texts.data[spans.starts[at]]
                upper, lower = (first >= 65) & (first <= 90), (first >= 97) & (first <= 122)
                before = hashes[np.maximum(at - 1, 0)]
                same = (at > 0) & (spans.row[np.maximum(at - 1, 0)] == spans.row[at])
                after = lambda some: same & (some[np.minimum(np.searchsorted(some, before), len(some) - 1)] == before)
                common = lower | upper & after(articles)
                proper = upper & ~common & ~after(given)
                key, place = np.unique(hashes[at], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(np.bincount(place, common, len(key)).astype(np.int64)),
                     pa.array(np.bincount(place, proper, len(key)).astype(np.int64))], ["hash", "common", "proper"])

    counts = docs.select(docs[text_column].cast("string")).mapInArrow(run, "hash bigint, common bigint, proper bigint")
    return counts.groupBy("hash").agg(F.sum("common").alias("common"), F.sum("proper").alias("proper"))


def verdicts_of(found: DataFrame, docs: DataFrame, text_column: str) -> DataFrame | None:
    """(value, common) of the words after given names that the corpus judges otherwise than the classifier."""
    asked = stored(found.where(F.col("kind").startswith("untitled-")).select("kind", "value").distinct(), "untitled")
    if asked.isEmpty():
        return None

    def hashed(batches):
        for batch in batches:
            hashes = word_hashes(batch.column("value").to_pylist()) if batch.num_rows else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes.view(np.int64))], ["kind", "value", "hash"])

    asked = stored(asked.mapInArrow(hashed, "kind string, value string, hash bigint"), "untitled")
    told = asked.join(written_as(docs, text_column, asked.select("hash")), "hash").where("common > 0 or proper > 0")
    told = told.select("kind", "value", (F.col("common") > F.col("proper")).alias("common"))
    return stored(told.where(F.col("common") != (F.col("kind") == "untitled-1")).select("value", "common"), "verdicts")


def drawn(values: DataFrame, key: bytes) -> DataFrame:
    """Add the surrogate to (kind, value, attempt)."""

    def run(batches):
        for batch in batches:
            new = [surrogate(key, k, v, a) for k, v, a in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())],
                                             [*batch.schema.names, "new"])

    return values.select("kind", "value", "attempt").mapInArrow(
        run, "kind string, value string, attempt int, new string")


def one_kind(found: DataFrame) -> DataFrame:
    """(kind, value, own) of the kinds and values of a corpus; ``own`` is the one kind that a value's surrogate has.

    It differs from the kind only for given names: one with a gender goes before one without, then that of more texts.
    """
    counted = found.groupBy("kind", "value").count()
    # A value has at most four kinds that are one.
    grouped = counted.groupBy(F.split("kind", "-")[0].alias("group"), "value").agg(
        F.max_by("kind", F.struct(F.col("kind") != "given-", "count", "kind")).alias("own"),
        F.collect_set("kind").alias("kinds"))
    return grouped.select(F.explode("kinds").alias("kind"), "value", "own")


def distinct_surrogates(values: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt, new) with all surrogates different, and none an atom of the corpus.

    Of atoms that share a surrogate the smallest keeps it. Given names of all genders and surnames are one group;
    other kinds are each one of their own. Addresses of hosts are permuted, so they differ as they are.
    """
    group = F.when(F.col("kind").startswith("given-") | (F.col("kind") == "surname"), "name").otherwise(F.col("kind"))
    taken = values.select(group.alias("group"), F.col("value").alias("new")).distinct().withColumn("real", F.lit(True))
    state = stored(drawn(values.withColumn("attempt", F.lit(0)), key), "surrogates")
    while True:
        grouped = state.withColumn("group", group).where(~F.col("group").isin("ip", "ip6"))
        owners = grouped.groupBy("group", "new").agg(F.min(F.struct("value", "kind")).alias("owner"), F.count("*").alias("n"))
        clashes = owners.join(taken, ["group", "new"], "left").where("n > 1 or real")
        clashes = stored(clashes.select("group", "new", "owner", "real"), "clashes")
        if not clashes.limit(1).count():
            return state
        marked = state.withColumn("group", group).join(clashes, ["group", "new"], "left").withColumn(
            "again", F.col("owner").isNotNull() & (
                F.coalesce("real", F.lit(False)) | (F.col("owner") != F.struct("value", "kind"))))
        marked = stored(marked.select("kind", "value", "attempt", "new", "again"), "marked")
        redone = drawn(marked.where("again").withColumn("attempt", F.col("attempt") + 1), key)
        state = stored(marked.where("not again").drop("again").unionByName(redone), "surrogates")


def pseudonymised(
    docs: DataFrame, key: bytes, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """doc_id, text with surrogates, n_entities and kinds (distinct, sorted) of every document row.

    ``key`` is secret: who has it can recompute surrogates. A null text stays null, an empty one empty. Texts without
    entities are returned as they are. Repeated rows give repeated results; an empty table an empty one. Numbers whose
    check digits are wrong, or that no issuer gives out, are no cards or account numbers and stay. A surname detected in a
    text is replaced wherever it stands there. Given the key, runs over other corpora give the same surrogates but for
    atoms that drew again. Ids may be of any type.
    """
    if len(key) < 16:
        raise ValueError("a key of at least 16 bytes is needed")
    texts = keyed(docs, id_column, text_column)
    no_verdicts = F.lit(None).cast("array<struct<value: string, common: boolean>>").alias("verdicts")
    found = stored(corpus_atoms(texts.select("*", no_verdicts)), "atoms")
    told = verdicts_of(found, docs, text_column)
    verdicts = None
    if told is not None and not told.isEmpty():
        verdicts = stored(found.where(F.col("kind").startswith("untitled-")).join(told, "value").groupBy(
            ROW_ID, ROW_HASH).agg(F.collect_set(F.struct("value", "common")).alias("verdicts")), "verdict-rows")
        found = stored(corpus_atoms(join_rows(texts, verdicts, "left")), "atoms")
    found = found.where(~F.col("kind").startswith("untitled-"))
    values = stored(one_kind(found), "atom-values")
    own = distinct_surrogates(values.select(F.col("own").alias("kind"), "value").distinct(), key)
    given = F.col("own").startswith("given-")
    others = own.where("attempt > 0").where(~F.col("kind").startswith("given-")).select("kind", "value", "new")
    named = values.where(given).join(own.withColumnRenamed("kind", "own").where(given), ["own", "value"])
    redrawn = named.where("attempt > 0 or kind <> own").select("kind", "value", "new").unionByName(others)
    redrawn = stored(redrawn, "redrawn")
    again = found.join(redrawn, ["kind", "value"]).groupBy(ROW_ID, ROW_HASH).agg(
        F.collect_list(F.struct("kind", "value", "new")).alias("again"))
    # Written, so that Spark knows how few there are and need not move the texts.
    texts = join_rows(texts, stored(again, "redrawn-rows"), "left")
    texts = texts.select("*", no_verdicts) if verdicts is None else join_rows(texts, verdicts, "left")

    def run(batches):
        for batch in batches:
            column = batch.column("__text")
            changed, counts, kinds = [], [], []
            for text, again, told in zip(readable(column), batch.column("again").to_pylist(),
                                         batch.column("verdicts").to_pylist(), strict=True):
                new, found = scrub(
                    text, key, {(a["kind"], a["value"]): a["new"] for a in again or ()},
                    {v["value"]: v["common"] for v in told or ()}) if text else (None, [])
                changed.append(new if found else None)
                counts.append(len(found))
                kinds.append(",".join(sorted({k.split("-")[0] for k in found})))
            out = pc.coalesce(pa.array(changed, pa.string()), column.cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW_ID), out, pa.array(counts, pa.int64()),
                 pa.array(kinds, pa.string())], ["doc_id", "text", "n_entities", "kinds"])

    kind = texts.schema[ROW_ID].dataType.simpleString()
    return texts.select(ROW_ID, "__text", "again", "verdicts").mapInArrow(
        run, f"doc_id {kind}, text string, n_entities bigint, kinds string")


def session_key(spark: SparkSession) -> bytes:
    """The key in ``spark.wardmap.surrogate.key``, or else a new random one: surrogates of one run then."""
    given = spark.conf.get("spark.wardmap.surrogate.key", None)
    return given.encode() if given else secrets.token_bytes(32)
