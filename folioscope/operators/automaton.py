"""One pass over a text for all of a vocabulary.

The lower-cased aliases and phrases of all kinds are the words of one Aho-Corasick
automaton; a text passes it once, whatever their number, and an occurrence tells its kinds,
canonical names and whether it must stand between word boundaries. Measures are looked for
only beside aliases that the text holds. A composition's form is one pattern with a
choice of all symbols, as two symbols never match in one place.

A worker builds the automaton once for a vocabulary, which is broadcast: it is what its
user wrote down, and ``BYTES`` is checked.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BYTES = 64 << 20
#: Kinds whose aliases may stand inside words, those that stand alone, and lists of phrases.
INSIDE, ALONE, PHRASES = ("properties", "processes"), ("applications", "materials"), ("problems", "solutions")
#: What a composition may look like, and which groups hold its values; {symbol} is an element's.
COMPOSITION = (
    (r"\b{symbol}\s*[:=]?\s*(\d+\.?\d*)\s*(%|mass\s*%|wt\s*%)", 1, None, 2),
    (r"\b{symbol}\s*[:=]?\s*(\d+\.?\d*)\s*(?:to|-)\s*(\d+\.?\d*)\s*(%|mass\s*%|wt\s*%)", 1, 2, 3),
    (r"(\d+\.?\d*)\s*(%|mass\s*%|wt\s*%)\s*(?:to|-)\s*(\d+\.?\d*)\s*(%|mass\s*%|wt\s*%)(?:\s+by\s+mass)?\s+(?:of\s+)?\b{symbol}\b", 1, 3, 4),
    (r"(\d+\.?\d*)\s*(%|mass\s*%|wt\s*%)(?:\s+by\s+mass)?\s+(?:or\s+less\s+)?(?:of\s+)?\b{symbol}\b", 1, None, 2),
)
#: The measure after a property's alias, and the temperature after a process's.
MEASURE = r"\s*(?:of|:)?\s*(\d+)\s*(MPa|%|T|W/kg)"
DEGREES = r".*?(\d+)\s*°?C"
SENTENCE = 300

_TEXT, _NUMBER = pa.string(), pa.float64()
_LISTS = {
    "composition": [("symbol", _TEXT), ("full", _TEXT), ("low", _NUMBER), ("high", _NUMBER), ("unit", _TEXT)],
    "properties": [("canon", _TEXT), ("alias", _TEXT), ("value", _TEXT), ("unit", _TEXT)],
    "processes": [("canon", _TEXT), ("alias", _TEXT), ("degrees", _TEXT)],
    "applications": [("canon", _TEXT), ("alias", _TEXT)],
    "materials": [("canon", _TEXT), ("alias", _TEXT)],
    "problems": [("phrase", _TEXT), ("sentence", _TEXT)],
    "solutions": [("phrase", _TEXT), ("sentence", _TEXT)],
}
_TYPE = pa.struct([(name, pa.list_(pa.struct(fields))) for name, fields in _LISTS.items()])
SCHEMA = "struct<" + ",".join(f"{name}:array<struct<" + ",".join(f"{f}:{'double' if t == _NUMBER else 'string'}" for f, t in fields) + ">>" for name, fields in _LISTS.items()) + ">"


@lru_cache(1 << 14)
def _after(alias: str, pattern: str) -> re.Pattern:
    return re.compile(re.escape(alias) + pattern, re.IGNORECASE)


def _in_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def sentence(text: str, at: int) -> str:
    """From after the full stop before a place through the next one."""
    stop = text.find(".", at)
    return text[text.rfind(".", 0, at) + 1 : stop + 1 if stop >= 0 else len(text)].strip()[:SENTENCE]


class Vocabulary:
    """``vocabulary`` as an automaton; called with a text it gives the lists of ``SCHEMA``."""

    def __init__(self, vocabulary: dict):
        import ahocorasick

        self.vocabulary, words = vocabulary, {}
        for kind in (*INSIDE, *ALONE):
            self._add(words, kind, vocabulary.get(kind, {}).items())
        for kind in PHRASES:
            self._add(words, kind, [(p, [p]) for p in vocabulary.get(kind, [])])
        self.everywhere = words.pop("", [])  # what every text holds
        self.automaton = ahocorasick.Automaton()
        for word, own in words.items():
            self.automaton.add_word(word, (len(word), own))
        self.automaton.make_automaton()
        self.elements = vocabulary.get("elements", {})
        self.symbols = {s.casefold(): (place, s) for place, s in reversed([*enumerate(self.elements)])}
        choice = "(?P<symbol>" + "|".join(re.escape(s) for s in sorted(self.elements, key=len, reverse=True)) + ")"
        self.forms = []
        for pattern, *groups in COMPOSITION if self.elements else ():
            form = re.compile(pattern.replace("{symbol}", choice), re.IGNORECASE)
            own = form.groupindex["symbol"]
            self.forms.append((form, *(g + (g >= own) if g else None for g in groups)))

    @staticmethod
    def _add(words: dict, kind: str, entries) -> None:
        for place, (canon, aliases) in enumerate(entries):
            for nth, alias in enumerate(aliases):
                # a phrase is looked for as it is written
                words.setdefault(alias if kind in PHRASES else alias.lower(), []).append((kind, place, nth, canon, alias))

    def found(self, low: str) -> dict:
        """The first alias in the list of each (kind, place of the canonical name) that a lower-cased text holds, with its first place in it."""
        best = {}

        def met(own, begin: int, end: int) -> None:
            for kind, place, nth, canon, alias in own:
                # a boundary is where only one side belongs to a word
                if kind in ALONE and (_in_word(low, begin - 1) == _in_word(low, begin) or _in_word(low, end - 1) == _in_word(low, end)):
                    continue
                old = best.get((kind, place))
                if old is None or (nth, begin) < old[:2]:
                    best[kind, place] = nth, begin, canon, alias

        for last, (length, own) in self.automaton.iter(low) if len(self.automaton) else ():
            met(own, last + 1 - length, last + 1)
        met([x for x in self.everywhere if x[0] not in ALONE], 0, 0)
        return best

    def composition(self, text: str) -> list[dict]:
        """In order of element, form and place; of equal spans the first counts; high is set for ranges."""
        every = []
        for form, (pattern, low, high, unit) in enumerate(self.forms):
            for m in pattern.finditer(text):
                place, symbol = self.symbols[m["symbol"].casefold()]
                every.append((place, form, m.start(), m.span(), {"symbol": symbol, "full": self.elements[symbol], "low": float(m[low]), "high": float(m[high]) if high else None, "unit": m[unit]}))
        spans, out = set(), []
        for *_, span, row in sorted(every, key=lambda x: x[:3]):
            if span not in spans:
                spans.add(span)
                out.append(row)
        return out

    def __call__(self, text: str | None) -> dict | None:
        if text is None:
            return None
        low = text.lower()
        out = {name: [] for name in _LISTS}
        for (kind, _), (_, begin, canon, alias) in sorted(self.found(low).items()):
            if kind == "properties":
                m = _after(alias, MEASURE).search(text)
                out[kind].append({"canon": canon, "alias": alias, "value": m and m[1], "unit": m and m[2]})
            elif kind == "processes":
                m = _after(alias, DEGREES).search(text)
                out[kind].append({"canon": canon, "alias": alias, "degrees": m and m[1]})
            elif kind in ALONE:
                out[kind].append({"canon": canon, "alias": alias})
            elif not out[kind]:  # the first phrase of the list; one a text
                told = sentence(text, begin)
                out[kind].append({"phrase": alias, "sentence": told})
        out["composition"] = self.composition(text) if "%" in text else []
        return out


_BUILT: dict[str, Vocabulary] = {}


def _built(key: str, vocabulary: str) -> Vocabulary:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Vocabulary(json.loads(vocabulary))
    return _BUILT[key]


def read(texts: pa.Array, find) -> pa.Array:
    """What ``find`` tells of each text; equal texts of a batch, such as set phrases, are read once."""
    told = texts.dictionary_encode()
    return pa.array([find(x) for x in told.dictionary.to_pylist()], _TYPE).take(told.indices)


def hits(spark: SparkSession, vocabulary: dict, text: Column) -> Column:
    """A struct of ``SCHEMA``, null for a null text."""
    told = json.dumps(vocabulary)
    if len(told) > BYTES:
        raise ValueError(f"a vocabulary of {len(told)} bytes is beyond the {BYTES} that are sent to every worker")
    held, key = spark.sparkContext.broadcast(told), uuid.uuid4().hex

    @F.arrow_udf(SCHEMA)
    def run(texts: pa.Array) -> pa.Array:
        return read(texts, _built(key, held.value))

    return run(text)
