"""Text that was decoded with the wrong character encoding.

Every chain of undoing steps gives a candidate text.  The description length
of a candidate is its size after compression with the dictionary of a
language, plus the cost of its chain; the shortest wins, and a text stays as
it is unless a chain makes it shorter.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters beyond ASCII by language.
LETTERS = {
    "en": "é",
    "fr": "àâæçéèêëîïôœùûüÿ",
    "es": "áéíñóúü",
    "pt": "àáâãçéêíóôõú",
    "de": "äöüß",
    "pl": "ąćęłńóśźż",
    "cs": "áčďéěíňóřšťúůýž",
    "sv": "åäöé",
    "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюяё",
    "ja": "",
}
#: Signs found in correct text of any of them.
SIGNS = "–—‘’“”„…•·«»‹›€£¥§©®°±²³¼½¾×÷№™¡¿ºª     　"
#: Encodings of one byte a character as which UTF-8 bytes may have been read.
READERS = ["latin-1", "cp1252", "cp1250", "cp1251", "cp1254", "cp1257", "iso8859-2", "iso8859-15", "iso8859-16", "mac_roman", "mac_latin2", "cp437", "cp850", "cp852", "cp866", "koi8-r", "iso8859-5", "mac_cyrillic"]
#: The same with several bytes a character.
WIDE_READERS = ["gb18030", "big5", "cp932", "cp949", "euc_jp"]
#: Encodings whose bytes may have been read as another of the same kind: (right, wrong).
SWAPS = [
    (right, wrong)
    for right, wrongs in {
        "cp1250": ["cp1252", "latin-1", "iso8859-2", "mac_roman", "cp1251", "cp850", "cp437"],
        "iso8859-2": ["cp1252", "latin-1", "cp1250", "mac_roman", "cp1251"],
        "cp1251": ["cp1252", "latin-1", "koi8-r", "mac_roman", "cp866", "iso8859-5", "cp1250", "mac_cyrillic", "cp850", "cp437"],
        "koi8-r": ["cp1251", "cp1252", "latin-1", "cp866", "iso8859-5", "mac_cyrillic"],
        "cp866": ["cp1251", "cp1252", "latin-1", "koi8-r", "mac_cyrillic", "cp437", "cp850"],
        "iso8859-5": ["cp1251", "cp1252", "latin-1", "koi8-r"],
        "cp1252": ["mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859-2", "koi8-r", "cp866", "latin-1"],
        "mac_roman": ["cp1252", "latin-1", "cp1251"],
        "cp850": ["cp1252", "latin-1", "mac_roman"],
        "cp437": ["cp1252", "latin-1"],
        "cp852": ["cp1252", "latin-1", "cp1250", "cp850"],
    }.items()
    for wrong in wrongs
]
#: The same where the right encoding takes several bytes a character.
WIDE_SWAPS = [(right, wrong) for right in ("cp932", "euc_jp", "gb18030") for wrong in ("latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp1251")]
#: Bytes a step adds to the description; what a letter adds that the language hasn't.
STEP_COST, WIDE_COST, SWAP_COST, STRANGE_COST, MOST_STEPS = 0.5, 1.5, 5, 1.5, 3
SAMPLE_TEXTS, DICTIONARY_BYTES, LEVEL = 4000, 32768, 12

_LOST = "�"
_NON_ASCII = re.compile(r"[^\x00-\x7f]+")


def _page(encoding: str) -> list[str]:
    """The character of each byte; bytes the encoding leaves undefined pass as control characters."""
    page = []
    for b in range(256):
        try:
            page.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            page.append(chr(b))
    return page


def _bytes_of(page: list[str]):
    """The byte of each character, for the library's encoder; of several the least."""
    return codecs.charmap_build("".join(page)) if len(set(page)) == 256 else {ord(c): b for b, c in reversed(list(enumerate(page)))}


class _Narrow:
    """Undoes UTF-8 read as an encoding of one byte a character, wherever the bytes are valid UTF-8."""

    cost, local = STEP_COST, True

    def __init__(self, encoding: str):
        self.name = f"utf-8 as {encoding}"
        page = _page(encoding)
        self.byte = {c: b for b, c in reversed(list(enumerate(page))) if b > 127}
        self.lead, self.tails = set(page[0xC2:0xF5]), set(page[0x80:0xC0])
        one = lambda a, b: "[" + "".join(re.escape(page[i]) for i in range(a, b + 1)) + "]"
        tail = one(0x80, 0xBF)
        self.find = re.compile(f"(?:{one(0xC2, 0xDF)}{tail}|{one(0xE0, 0xEF)}{tail}{tail}|{one(0xF0, 0xF4)}{tail}{tail}{tail})+")

    def may(self, chars: frozenset[str], good: set[str]) -> bool:
        return not chars.isdisjoint(self.lead) and not chars.isdisjoint(self.tails)

    def _right(self, m: re.Match) -> str:
        try:
            return bytes(self.byte[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    def undo(self, text: str) -> str:
        return self.find.sub(self._right, text)


class _Wide:
    """The same for encodings of several bytes a character; a run may have swallowed ASCII characters or lost its end."""

    cost, local = WIDE_COST, True

    def __init__(self, encoding: str):
        self.name, self.encoding = f"utf-8 as {encoding}", encoding

    def may(self, chars: frozenset[str], good: set[str]) -> bool:
        return any(c > "\u2e7f" for c in chars)

    def _right(self, m: re.Match) -> str:
        try:
            return m.group().encode(self.encoding).decode("utf-8")
        except UnicodeError:
            return m.group()

    def undo(self, text: str) -> str:
        return _NON_ASCII.sub(self._right, text)


class _Stripped:
    """UTF-8 read as Latin-1 whose control characters somebody removed: what is left of a sign, and the sign it most likely was."""

    cost, local = WIDE_COST + 1, True

    def __init__(self, lone: dict[str, str], first: bool = False):
        self.name, self.first, self.lone = f"utf-8 as latin-1 without controls ({''.join(lone.values())})", first, set(lone)
        self.letters = [(re.compile(f"{lead}(?![\u0080-\u00bf])"), letter) for lead, letter in lone.items()]

    def may(self, chars: frozenset[str], good: set[str]) -> bool:
        return not chars.isdisjoint(self.lone) or (self.first and "â" in chars)

    def undo(self, text: str) -> str:
        text = _signs_without_controls(text)
        for find, letter in self.letters:
            text = find.sub(letter, text)
        return text


_LEFT_OF_SIGNS = [
    (re.compile(a), b)
    for a, b in (
        ("â¬", "€"), ("â¦", "…"), ("â¢", "•"), (r"(?<=\w)â(?=(?i:t|s|re|ve|ll|d|m)\b)", "’"), (r"(?<=\b[ldcjmnstLDCJMNST])â(?=\w)", "’"), (r"(?<!\S)â(?!\S)", "–"),
        (r"(?<!\w)â(?=\w)([^â]*)(?<=\w)â(?!\w)", r"“\1”"),
    )
]


@lru_cache(10_000)
def _signs_without_controls(text: str) -> str:
    for find, sign in _LEFT_OF_SIGNS:
        text = find.sub(sign, text)
    return text


class _Swap:
    """Undoes one encoding of one byte a character read as another, over the whole text."""

    cost, local = SWAP_COST, False

    def __init__(self, right: str, wrong: str):
        self.name = f"{right} as {wrong}"
        good, bad = _page(right), _page(wrong)
        self.map = {bad[b]: good[b] for b in range(255, 127, -1)}
        self.bytes, self.page = _bytes_of(bad), "".join(good)
        self.same = {c for c, n in self.map.items() if c == n}
        self.allowed: set[str] | None = None

    def may(self, chars: frozenset[str], good: set[str]) -> bool:
        if self.allowed is None:
            self.allowed = {c for c, n in self.map.items() if n in good}
        return chars <= self.allowed and not chars <= self.same

    def undo(self, text: str) -> str:
        return codecs.charmap_decode(codecs.charmap_encode(text, "strict", self.bytes)[0], "strict", self.page)[0]


class _WideSwap:
    """Undoes an encoding of several bytes a character read as one of one byte."""

    cost, local = SWAP_COST, False

    def __init__(self, right: str, wrong: str):
        self.name, self.right = f"{right} as {wrong}", right
        page = _page(wrong)
        self.chars, self.bytes = set(page), _bytes_of(page)

    def may(self, chars: frozenset[str], good: set[str]) -> bool:
        return len(chars) > 1 and chars <= self.chars

    def undo(self, text: str) -> str:
        try:
            return codecs.charmap_encode(text, "strict", self.bytes)[0].decode(self.right)
        except UnicodeError:
            return text


def _letters(extra: dict[str, str]) -> dict[str, set[str]]:
    found = {lang: set(x) | set(x.upper()) for lang, x in extra.items()}
    if "ja" in found:
        found["ja"] |= {chr(c) for a, b in ((0x3001, 0x3030), (0x3041, 0x3100), (0x4E00, 0xA000), (0xFF01, 0xFF61)) for c in range(a, b)}
    return found


@dataclass
class Model:
    """Language dictionaries by language code, and what text may hold."""

    dictionaries: dict[str, bytes]
    letters: dict[str, str] = field(default_factory=lambda: LETTERS)
    most_steps: int = MOST_STEPS

    def ready(self) -> Repairer:
        return Repairer(self)


@dataclass(frozen=True)
class Verdict:
    text: str
    chain: str
    saved: int
    garbled: bool


class Repairer:
    """Decides one text at a time; remembers what it decided."""

    def __init__(self, model: Model):
        self.letters = _letters(model.letters)
        self.signs = set(SIGNS)
        self.good = set().union(self.signs, *self.letters.values())
        self.most_steps = model.most_steps
        self.press = {}
        for lang, raw in model.dictionaries.items():
            kind = zstandard.DICT_TYPE_AUTO if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            d = zstandard.ZstdCompressionDict(raw, dict_type=kind)
            d.precompute_compress(level=LEVEL)
            self.press[lang] = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.steps = [_Narrow(e) for e in READERS] + [_Wide(e) for e in WIDE_READERS] + [_Stripped({"Ã": c}, c == "É") for c in "ÉÀÁÚÓÖÜÄÑÇß"] + [_Stripped({"Å": a, "Ä": b}) for a, b in ("łę", "żą", "ść", "ńę", "řě", "žč", "šď")] + [_Swap(*x) for x in SWAPS] + [_WideSwap(*x) for x in WIDE_SWAPS]
        outside = lambda known: re.compile("[^\\x00-\\x7f" + re.escape("".join(sorted(known))) + "]")
        self.beyond = {lang: outside(self.signs | own) for lang, own in self.letters.items()}
        self.unknown = outside(self.good)
        self.possible: dict[frozenset[str], list] = {}
        self.spoken: dict[frozenset[str], set[str]] = {}
        self.known: dict[str, Verdict] = {}

    def _chars(self, text: str) -> frozenset[str]:
        return frozenset("".join(_NON_ASCII.findall(text)))

    def applicable(self, text: str) -> list:
        """The steps that could change a text with these characters."""
        chars = self._chars(text)
        steps = self.possible.get(chars)
        if steps is None:
            if len(self.possible) > 100_000:
                self.possible.clear()
            steps = self.possible[chars] = [s for s in self.steps if s.may(chars, self.good)]
        return steps

    def languages(self, text: str) -> set[str]:
        """Those whose letters cover most of the text's; all of them for a text without a letter beyond ASCII."""
        chars = self._chars(text)
        best = self.spoken.get(chars)
        if best is None:
            if len(self.spoken) > 100_000:
                self.spoken.clear()
            score = {lang: len(chars & own) for lang, own in self.letters.items()}
            most = max(score.values(), default=0)
            best = self.spoken[chars] = {lang for lang, x in score.items() if x == most}
        return best

    def length(self, text: str, languages: set[str]) -> float:
        """Bytes of the text, without regard to case, with the best dictionary; a letter the language hasn't costs more."""
        data = text.lower().encode("utf-8", "surrogatepass")
        rest = "".join(_NON_ASCII.findall(text))
        return min([len(self.press.get(lang, self.plain).compress(data)) + STRANGE_COST * len(self.beyond[lang].findall(rest)) for lang in languages])

    def covered(self, text: str) -> bool:
        """Whether one language has all letters of the text."""
        return any(not beyond.search(text) for beyond in self.beyond.values())

    def strange(self, text: str) -> int:
        """Characters that no correct text holds."""
        return len(self.unknown.findall(text))

    def suspicious(self, text: str) -> bool:
        """Whether some step that works on parts of a text leaves nothing strange where it changed something."""
        if _LOST in text or any("\x80" <= c <= "\x9f" for c in text):
            return True
        before = self.strange(text)
        for step in self.applicable(text):
            if step.local and (other := step.undo(text)) != text and self.strange(other) <= before:
                return True
        return False

    def decide(self, text: str) -> Verdict:
        known = self.known.get(text)
        if known is None:
            if len(self.known) > 200_000:
                self.known.clear()
            known = self.known[text] = self._decide(text)
        return known

    def _decide(self, text: str) -> Verdict:
        if text.isascii():
            return Verdict(text, "", 0, False)
        seen, level, found = {text}, [(text, "", 0.0, self.strange(text))], []
        for _ in range(self.most_steps):
            after = []
            for old, chain, cost, strange in level:
                for step in self.applicable(old):
                    if not step.local and chain:
                        continue
                    new = step.undo(old)
                    if new in seen:
                        continue
                    seen.add(new)
                    left = self.strange(new)
                    if left <= strange:
                        one = (new, f"{chain}, {step.name}" if chain else step.name, cost + step.cost, left)
                        found.append(one)
                        if step.local:
                            after.append(one)
            level = after
        lost = _LOST in text
        if not found:
            return Verdict(text, "", 0, lost)
        tongues = [self.languages(one[0]) for one in found]
        own = self.length(text, set.union(self.languages(text), *tongues))
        size, best = min(((self.length(one[0], t) + one[2], one) for one, t in zip(found, tongues, strict=True)), key=lambda x: x[0])
        if size < own:
            return Verdict(best[0], best[1], round(own - size), True)
        return Verdict(text, "", 0, lost)


def fit(texts: DataFrame, text: str, letters: dict[str, str] | None = None, sample_texts: int = SAMPLE_TEXTS) -> Model:
    """Language dictionaries from a bounded sample of texts without signs of a wrong encoding.

    At most ``sample_texts`` distinct texts a language, those of smallest
    hash, are looked at on the driver; a text belongs to the languages whose
    letters cover it best.  Texts beyond 1000 characters are not sampled.
    """
    letters = letters or LETTERS
    values = texts.select(F.col(text).alias("text")).where(F.col("text").isNotNull() & F.length("text").between(1, 1000))
    judge = Repairer(Model({}, letters))
    tests = []
    for lang, own in letters.items():
        chars = "ぁ-ヿ" if lang == "ja" else "".join(sorted(set(own + own.upper())))
        rare = [c for c in own if sum(c in x for x in letters.values()) == 1]
        mark = "".join(sorted(set("".join(rare) + "".join(rare).upper()))) or chars
        tests.append((lang, f"[{mark}]"))

    def pick(rest):
        chosen = F.when(rest == "", F.lit("en")).otherwise(F.lit("other"))
        for lang, mark in tests:
            chosen = F.when(rest.rlike(mark), F.lit(lang)).otherwise(chosen)
        return chosen

    # The letters beyond ASCII are taken out once; the tests see only these few.
    tagged = F.transform(F.array(F.regexp_replace("text", "[\\x00-\\x7f]+", "")), pick)[0]
    named = values.select("text", tagged.alias("lang"), F.xxhash64("text").alias("h"))
    counts = {row.lang: row.n for row in named.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    bound = F.lit(2**63 - 1)  # a share of each language's hashes that holds about a fifth more than is wanted
    shares = [x for lang, n in counts.items() if n > 2 * sample_texts for x in (F.lit(lang), F.lit(-(2**63) + int(1.2 * sample_texts / n * 2**64)))]
    if shares:
        bound = F.coalesce(F.try_element_at(F.create_map(*shares), F.col("lang")), bound)
    sampled = named.where(F.col("h") <= bound).distinct()
    chosen: dict[str, list] = {}
    for row in sorted(sampled.collect(), key=lambda r: (r.h, r.text)):
        chosen.setdefault(row.lang, []).append(row.text)
    samples: dict[str, list[bytes]] = {lang: [] for lang in letters}
    for lang in [*letters, "other"]:
        for text in chosen.get(lang, [])[:sample_texts]:
            if not judge.suspicious(text) and judge.covered(text):
                for own in judge.languages(text) if not text.isascii() else ["en"]:
                    samples[own].append(text.lower().encode())
    dictionaries = {}
    for lang, some in samples.items():
        try:
            dictionaries[lang] = zstandard.train_dictionary(DICTIONARY_BYTES, some, level=LEVEL).as_bytes()
        except (zstandard.ZstdError, ValueError):
            dictionaries[lang] = b"\n".join(some)[-DICTIONARY_BYTES:] or b" "
    return Model(dictionaries, letters)


def repair(df: DataFrame, record_id: str, fields: list[str], model: Model) -> DataFrame:
    """One row per garbled record and field: id, field, original, repaired, chain, saved.

    A value is garbled when a chain of undoing steps shortens its description
    or when characters were lost for good (U+FFFD); of the latter what can be
    restored is.  repaired is the value itself where nothing can be.  Nulls,
    empty texts and texts in ASCII are never garbled.  Repeated rows give
    repeated results; texts of any length are decided whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    long = df.select(F.col(record_id).alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("original")) for f in fields])).alias("x")).select("id", "x.field", "x.original")
    long = long.where(F.col("original").rlike("[^\\x00-\\x7f]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value.ready()
        for batch in batches:
            kept, verdicts = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                v = judge.decide(text)
                if v.garbled:
                    kept.append(i)
                    verdicts.append(v)
            part = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([v.text.encode("utf-8", "replace").decode() for v in verdicts], pa.string()), pa.array([v.chain for v in verdicts], pa.string()), pa.array([v.saved for v in verdicts], pa.int32())],
                ["id", "field", "original", "repaired", "chain", "saved"],
            )

    return long.mapInArrow(run, f"id {dict(df.dtypes)[record_id]}, field string, original string, repaired string, chain string, saved int")
