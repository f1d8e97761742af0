"""Personal data replaced by keyed surrogates.

Detected entities (e-mail, IPv4 and IPv6 addresses, phone, card, account and 3-2-4 id
numbers, secrets, names after a form of address and their bare mentions in the same
document) give way to surrogates of the same type and format:
digits stay digits between the same separators, a card number keeps its issuer digit
and whether its check digit holds, letters keep their case, a name its gender and
script. A surrogate depends on the key and the entity's canonical form alone, so all
mentions of an entity, in any spelling or document, get the same one (coreference).

Number surrogates are keyed permutations, so different entities of a type stay
different; what remains is checked over the corpus: no surrogate may equal a real
entity or another's surrogate (distinctness). Those that do are drawn again, in rounds
over keyed hashes of the entities -- no entity is written to disk -- until none is
left, and the few redrawn ones reach their documents by a join.

Defined cases: a null text stays null, an empty one empty; a text without entities is
unchanged; repeated rows are replaced alike; null doc_ids are kept; other columns pass
through untouched.
"""
from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_batches, stored

#: Attempts drawn at first; twice as many whenever they do not settle all collisions.
ATTEMPTS = 8
#: So many draws without an end mean that a type has fewer surrogates than entities.
MOST_ATTEMPTS = 1024
#: Forms of address: (words, gender).
ADDRESS = [("Mr|Sir|Herr|Herrn|Monsieur|Señor|Sr|Don|господин", "m"),
           ("Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Señora|Sra|Doña|госпожа", "f"), ("Dr|Prof", "n")]
#: Given names by script and gender.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul".split(),
    ("latin", "f"): "Anna Berta Clara Diana Emma Flora Greta Helena Irene Julia Karla Laura Maria Nora Olga Paula".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Марк Олег Павел Роман Семён Тимур Фёдор".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Инна Кира Лариса Мария Нина Ольга Полина Рита София".split(),
}
SYLLABLES = {"latin": "ba be bo da de do ga ge la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo za ze zo".split(),
             "cyrillic": "ба бе бо да де до га ге ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве во за зе зо".split()}
def _class(*categories: str) -> str:
    """The inside of a character class of all letters of some Unicode categories."""
    out, start = [], None
    for k in range(sys.maxunicode + 2):
        held = k <= sys.maxunicode and unicodedata.category(chr(k)) in categories
        if held and start is None:
            start = k
        elif not held and start is not None:
            out.append(f"\\U{start:08x}-\\U{k - 1:08x}")
            start = None
    return "".join(out)


#: Capitals, and letters and marks of any case; letters of scripts without case can start a name too.
_UP, _CASELESS = _class("Lu", "Lt"), _class("Lo")
_LETTER = _UP + _CASELESS + _class("Ll", "Lm", "Mn", "Mc")
_PART = rf"[{_UP}{_CASELESS}](?:['’](?=[{_UP}])|[{_LETTER}])+"
_WORD = rf"(?:{_PART}(?:-{_PART})*|[{_CASELESS}])"
_INITIALS = rf"(?:[{_UP}]\.\s?){{0,8}}"
_NAME = rf"{_INITIALS}{_WORD}(?:\s{_INITIALS}{_WORD})?"
#: Words that follow a form of address by chance ("Oak Dr. The"): no bare mentions.
_NO_NAMES = frozenset("the a an in on at he she it we you they i and but or if when this that his her is was to of for my "
                      "der die das und le la les el los las y et i в и на он она".split())
_H = "[0-9A-Fa-f]{1,4}"
_IP6 = (rf"(?:(?:{_H}:){{7}}{_H}|(?=[0-9A-Fa-f:]*\d)(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{{3}})(?!(?:[0-9A-Fa-f]*:){{8}})"
        rf"(?:(?:{_H}:){{1,6}}(?::{_H}){{1,6}}|(?:{_H}:){{1,7}}:|::{_H}(?::{_H}){{0,6}}))")
#: Numbers that are phones without any separator; a surrogate is of the same of these forms, or of none.
_BARE_PHONE = r"(?:[2-9]\d{2}[2-9]\d{6}|1[2-9]\d{2}[2-9]\d{6}|0[1-9]\d{8,9})"
_PHONES = [
    r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\w)",
    r"(?:\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d|(?<!\d[ .-])0[1-9])(?:[ .-]\d{2}){4}(?!\w|[ .-]\d{2}(?!\d))",
    r"(?:\+\d{1,3}[ .-]?|8[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{2}[ .-]\d{2}(?!\w)",
    r"\+[1-9]\d{6,14}(?!\w)",
    r"\+[1-9]\d{0,2}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]\d{2,5}){2,5}(?!\w)",
    rf"(?<![.,/-]){_BARE_PHONE}(?!\w|[.,-]\d)",
]
#: Country codes of one and two digits; the others have three.
_COUNTRY = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3}")
PATTERN = re.compile("|".join([
    r"(?P<email>[A-Za-z0-9._%+-]*[A-Za-z0-9]@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+)",
    rf"(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f]{{0,4}}:){_IP6}(?![\w:]))",
    r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))",
    r"(?P<secret>(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:AKIA|ghp_|sk-)[A-Za-z0-9]{16,64})(?![A-Za-z0-9]))",
    r"(?P<account>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))",
    r"(?P<card>(?<![\d-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{4}|\d{4}(?P<gap2>[ -])\d{6}(?P=gap2)\d{4,5})(?![\d-]))",
    r"(?P<id>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
    rf"(?P<phone>(?<![\w+])(?:{'|'.join(_PHONES)}))",
    *(rf"(?P<person_{g}>\b(?:{words})\.?\s{_NAME})" for words, g in ADDRESS),
]))
#: Entities hold a digit, an @ or a form of address; other texts are not searched.
_WORTH = re.compile("[0-9@]|" + "|".join(rf"\b(?:{w})\b" for w, _ in ADDRESS))


#: A name's words and initials.
_NAME_PARTS = re.compile(r"[^\s.]+\.?")


@lru_cache(None)
def _letters(script: str) -> list[str]:
    """Small or caseless letters without marks of a script, by its Unicode name."""
    found = (chr(k) for k in range(0x61, 0x10000) if unicodedata.category(chr(k)) in ("Ll", "Lo"))
    if script == "latin":
        return list("abcdefghijklmnopqrstuvwxyz")
    return [c for c in found if unicodedata.name(c, "").lower().startswith(f"{script} ") or
            script == "cjk" and "\u4e00" <= c <= "\u9fff" if unicodedata.normalize("NFKD", c) == c and len(c.upper()) == 1]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


class Surrogates:
    """Surrogates under one key. ``attempt`` draws another for the same entity."""

    def __init__(self, key: bytes):
        self.key = key
        self.number = lru_cache(1 << 15)(self._number)

    def _draw(self, *parts) -> int:
        return int.from_bytes(hmac.digest(self.key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256), "big")

    def hash(self, kind: str, canonical: str) -> str:
        """A keyed name of an entity; says nothing without the key."""
        return f"{self._draw('name', kind, canonical) >> 128:032x}"

    def _permuted(self, kind: str, digits: str, tweak: int | str, base: int = 10) -> str:
        """A keyed permutation of the digit strings of one length (Feistel rounds)."""
        n = len(digits)
        if n == 1:
            return str((int(digits) + self._draw(kind, "shift", tweak)) % 10)
        left, right = digits[:n // 2], digits[n // 2:]
        for k in range(8):
            size = len(left)
            mixed = (int(left, base) + self._draw(kind, n, tweak, k, right)) % base ** size
            left, right = right, (f"{mixed:0{size}d}" if base == 10 else f"{mixed:0{size}x}")
        return left + right

    def _number(self, kind: str, digits: str, attempt: int) -> str:
        if kind == "card":
            if luhn(digits):
                body = digits[0] + self._permuted(kind, digits[1:-1], attempt)
                return next(body + c for c in "0123456789" if luhn(body + c))
            out = digits
            while True:  # walk the permutation's cycle to a number that fails the check too
                out = digits[0] + self._permuted(kind, out[1:], attempt)
                if not luhn(out):
                    return out
        if kind == "ip":
            out = "".join(f"{int(x):02x}" for x in digits.split("."))
            while True:
                out = self._permuted(kind, out, attempt, 16)
                octets = [int(out[k:k + 2], 16) for k in (0, 2, 4, 6)]
                if 1 <= octets[0] <= 254:
                    return ".".join(map(str, octets))
        if kind == "phone":  # cycles walked within a form of bare phones, or outside of them
            def form(number: str) -> str:
                return "" if not re.fullmatch(_BARE_PHONE, number) else number[0] if number[0] in "01" else "2-9"
            out = digits
            while True:
                out = self._permuted(kind, out, attempt)
                if form(out) == form(digits):
                    return out
        if kind == "ip6":  # the groups that are zero stay zero, the others do not become it
            groups = digits.split(":")
            held = [k for k, g in enumerate(groups) if int(g, 16)]
            tweak = f"{attempt}:{held}"
            out, found = "".join(groups[k] for k in held), re.fullmatch(_IP6, str(ipaddress.ip_address(digits))) is not None
            while held:
                out = self._permuted(kind, out, tweak, 16)
                for k, g in zip(held, range(0, len(out), 4)):
                    groups[k] = out[g:g + 4]
                if all(int(groups[k], 16) for k in held) and found == (
                        re.fullmatch(_IP6, str(ipaddress.ip_address(":".join(groups)))) is not None):
                    break
            return ":".join(groups)
        return self._permuted(kind, digits, attempt)

    def _syllables(self, number: int, script: str, count: int) -> str:
        own = SYLLABLES.get(script) or _letters(script)
        return "".join(own[number // len(own) ** k % len(own)] for k in range(count))

    def canonical(self, kind: str, text: str) -> str:
        if kind in ("card", "id"):
            return re.sub(r"\D", "", text)
        if kind == "phone":  # with the country code told apart
            return "+" * text.startswith("+") + re.sub(r"\D", "", text)
        if kind == "ip6":
            return ipaddress.ip_address(text).exploded
        if kind == "account":
            return text.replace(" ", "")
        if kind.startswith("person"):
            return self.canonical("name", text.split(maxsplit=1)[1])
        if kind.startswith("name"):
            return " ".join(_NAME_PARTS.findall(text)).lower()
        if kind == "ip":
            return ".".join(str(int(x)) for x in text.split("."))
        return text.lower() if kind in ("email", "secret") else text

    def entities(self, kind: str, text: str) -> list[tuple[str, str, str]]:
        """(kind, canonical form, mention) of what is drawn for a mention: a person's
        surname is drawn on its own, for all who have it."""
        if not kind.startswith(("person", "name")):
            return [(kind, self.canonical(kind, text), text)]
        name = text.split(maxsplit=1)[1] if kind.startswith("person") else text
        *given, last = _NAME_PARTS.findall(name)
        family = ("name", self.canonical("name", last), last)
        return [(f"person{kind[-2:]}", self.canonical("name", name), f"x {name}"), family] if given else [family]

    def __call__(self, kind: str, text: str, attempt: int = 0, of_family: int = 0) -> str:
        """The surrogate in the format of ``text``; ``of_family`` is the attempt of the
        surname of a person with other names."""
        own = self.canonical(kind, text)
        if kind in ("card", "phone", "id"):
            keep = 0
            if kind == "phone" and own.startswith("+"):  # the country code stays
                own = own[1:]
                keep = len(_COUNTRY.match(own)[0])
            new = iter(own[:keep] + self.number(kind, own[keep:], attempt))
            return re.sub(r"\d", lambda _: next(new), text)
        if kind == "ip":
            return self.number(kind, own, attempt)
        if kind == "ip6":
            new = iter(g for g in self.number(kind, own, attempt).split(":") if int(g, 16))

            def group(m: re.Match) -> str:
                if not int(m[0], 16):
                    return m[0]
                out = next(new)
                out = out if len(m[0]) == 4 and m[0][0] == "0" else out.lstrip("0")
                return out.upper() if re.search("[A-F]", text) else out
            return re.sub("[0-9A-Fa-f]+", group, text)
        if kind == "account":
            digits = re.sub(r"\D", "", own)
            new = iter(self.number(kind, digits, attempt))
            letters = self._draw(kind, own, attempt)
            out = []
            for k, c in enumerate(text):
                if c.isdigit():
                    out.append(next(new))
                elif k > 1 and c.isalpha():
                    out.append(chr(65 + letters // 26 ** k % 26))
                else:
                    out.append(c)
            return "".join(out)
        drawn = self._draw(kind, own, attempt)
        if kind == "secret":
            start = next((p for p in ("akia", "ghp_", "sk-") if own.startswith(p)), "")
            out = text[:len(start)] + f"{drawn:064x}{self._draw(kind, own, attempt, 'more'):064x}"[:len(text) - len(start)]
            return out.upper() if text.isupper() else out
        if kind == "email":
            out = f"{self._syllables(drawn, 'latin', 8)}.{drawn >> 200:d}"[:24] + "@" + \
                re.sub(r"[a-z]+", lambda m: self._syllables(drawn >> 80, "latin", 4), own.split("@")[1].split(".")[0]) + ".example.org"
            return out.upper() if text.isupper() else out
        address, name = text.split(maxsplit=1) if kind.startswith("person") else ("", text)
        *names, last = _NAME_PARTS.findall(name)
        script = unicodedata.name(last[0]).split()[0].lower()
        # The family name's surrogate hangs on the family name alone: a later mention without the given name agrees.
        new = self._syllables(self._draw("family", last.lower(), of_family if names else attempt), script,
                              6 if script in SYLLABLES else 3 if script == "cjk" else 8).capitalize()
        out = [new.upper() if last.isupper() and len(last) > 1 else new]
        if names:
            drawn = self._draw(f"person{kind[-2:]}", own, attempt)
            gender = kind[-1] if kind[-1] != "n" else "mf"[self._draw("gender", own) % 2]
            if script in SYLLABLES:
                given = GIVEN[script, gender][drawn % 16]
                if attempt:  # namesakes outnumber the list: a second part, longer with every attempt
                    given += "-" + self._syllables(drawn >> 8, script, min(attempt + 1, 8)).capitalize()
            else:
                given = self._syllables(drawn >> 8, script, (2 if script == "cjk" else 5) + min(attempt, 8)).capitalize()
            capitals = [c.upper() for c in _letters(script)]
            letters = [capitals[(drawn >> 100 + 8 * k) % len(capitals)] for k in range(16)]
            alone = all(n.endswith(".") for n in names)
            for k, n in enumerate(names):
                if not n.endswith("."):
                    word = given.upper() if n.isupper() and len(n) > 1 else given
                elif alone and not k:  # initials only: more of them with every attempt
                    word = " ".join(c + "." for c in letters[8:9 + min(attempt, 4)])
                else:
                    word = letters[k] + "."
                out.insert(k, word)
        parts = iter(out)
        return (address and text[:len(text) - len(name)]) + _NAME_PARTS.sub(lambda _: next(parts), name)


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every entity, in order, without overlaps."""
    if not text or not _WORTH.search(text):
        return []
    out, names = [], {}
    for m in PATTERN.finditer(text):
        kind = "card" if m.lastgroup.startswith("gap") else m.lastgroup
        out.append((m.start(), m.end(), kind))
        if kind.startswith("person"):
            name = m[0].split(maxsplit=1)[1]
            *given, last = _NAME_PARTS.findall(name)
            for own, bare in ((name, f"name{kind[-2:]}"), (last, "name"))[not given:]:
                if own.lower() not in _NO_NAMES:
                    names.setdefault(own, bare)
                    names.setdefault(own.upper(), bare)
    if names:
        mention = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?!\w)")
        at, more = 0, []
        for a, b, _ in [*out, (len(text), len(text), "")]:
            more += [(m.start(), m.end(), names[m[0]]) for m in mention.finditer(text, at, a)]
            at = b
        out = sorted(out + more)
    return out


def _found(docs: DataFrame, key: bytes, attempts: int = ATTEMPTS) -> DataFrame:
    """(doc_id, text_hash, kind, own, drawn): each entity of each document once, by keyed
    hashes; ``drawn`` names the surrogates of the attempts in turn."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        make = Surrogates(key)
        rows, kinds, names, drawn, known = [], [], [], [], {}
        for k, text in enumerate(batch.column("text").to_pylist()):
            mentions = dict.fromkeys((kind, text[a:b]) for a, b, kind in entities(text))
            each = {e[:2]: e for m in mentions for e in make.entities(*m)}
            for entity, (kind, _, own) in each.items():
                if entity not in known:
                    known[entity] = (make.hash(*entity), [make.hash(kind, make.canonical(kind, make(kind, own, a)))
                                                          for a in range(attempts)])
                rows.append(k)
                kinds.append(kind)
                names.append(known[entity][0])
                drawn.append(known[entity][1])
        take = pa.array(rows, pa.int64())
        return pa.record_batch({"doc_id": batch.column("doc_id").take(take), "text_hash": batch.column("text_hash").take(take),
                                "kind": pa.array(kinds, pa.string()), "own": pa.array(names, pa.string()),
                                "drawn": pa.array(drawn, pa.list_(pa.string()))})
    given = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).where("text IS NOT NULL")
    schema = T.StructType([given.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("kind", T.StringType()),
                           T.StructField("own", T.StringType()), T.StructField("drawn", T.ArrayType(T.StringType()))])
    return map_batches(given, run, schema)


class Unsettled(RuntimeError):
    """The attempts drawn do not settle all collisions."""


def redrawn(found: DataFrame) -> DataFrame | None:
    """(own, attempt) of the entities whose first surrogate collides, or None."""
    known = stored(found.groupBy("own").agg(F.first("drawn").alias("drawn")), "entities")
    attempts = (known.select(F.size("drawn")).first() or [1])[0]
    todo, settled, out = known, None, []
    for attempt in range(attempts):
        drawn = todo.select("own", F.col("drawn")[attempt].alias("value"))
        taken = known.select(F.col("own").alias("value"), F.lit(None).cast("string").alias("own"), F.lit(True).alias("real"))
        if settled is not None:
            taken = taken.union(settled.select("value", F.lit(None).cast("string"), F.lit(True)))
        first = (taken.union(drawn.select("value", "own", F.lit(False))).groupBy("value")
                 .agg(F.min("own").alias("first"), F.bool_or("real").alias("real")))
        judged = drawn.join(first.where("first IS NOT NULL"), "value").withColumn(
            "good", ~F.col("real") & (F.col("own") == F.col("first")))
        judged = stored(judged.select("own", "value", "good"), "judged")
        good, bad = judged.where("good"), judged.where("not good")
        if attempt:
            out.append(good.select("own", F.lit(attempt).alias("attempt")))
        if not bad.limit(1).count():
            break
        settled = good.select("value") if settled is None else settled.union(good.select("value"))
        todo = stored(todo.join(bad.select("own"), "own", "left_semi"), "todo")
    else:
        raise Unsettled(f"surrogates still collide after {attempts} attempts")
    if not out:
        return None
    for more in out[1:]:
        out[0] = out[0].union(more)
    return stored(out[0], "redrawn")


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with every entity of ``text`` replaced, and their number as a last column
    ``n_replaced`` (underscores follow where ``docs`` has that name)."""
    attempts = ATTEMPTS
    while True:
        found = stored(_found(docs, key, attempts), "found")
        try:
            again = redrawn(found)
            break
        except Unsettled:
            attempts *= 2
            if attempts > MOST_ATTEMPTS:
                raise
    columns, with_maps = docs.columns, docs
    count, redo_map = free_name(columns, "n_replaced"), free_name(columns, "_again")
    if again is not None:
        maps = (found.select("doc_id", "text_hash", "own").join(again, "own").groupBy("doc_id", "text_hash")
                .agg(F.map_from_entries(F.collect_set(F.struct("own", "attempt"))).alias("redo")))
        maps = maps.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("redo").alias(redo_map))
        with_maps = docs.join(maps, docs["doc_id"].eqNullSafe(maps["_id"]) & (F.xxhash64(docs["text"]) == maps["_hash"]),
                              "left").select(*[docs[c] for c in columns], maps[redo_map])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        make, texts, counts = Surrogates(key), [], []
        attempts = batch.column(redo_map).to_pylist() if redo_map in batch.schema.names else [None] * batch.num_rows
        for text, redo in zip(batch.column("text").to_pylist(), attempts):
            redo, out, at = dict(redo or ()), [], 0
            spans = entities(text)
            for a, b, kind in spans:
                own = text[a:b]
                tries = [redo.get(make.hash(*e[:2]), 0) for e in make.entities(kind, own)] if redo else [0]
                out += [text[at:a], make(kind, own, *tries)]
                at = b
            texts.append("".join([*out, text[at:]]) if spans else text)
            counts.append(len(spans))
        given = {c: batch.column(c) for c in columns} | {"text": pa.array(texts, pa.string())}
        return pa.record_batch(given | {count: pa.array(counts, pa.int64())})
    schema = T.StructType([*docs.schema, T.StructField(count, T.LongType())])
    return map_batches(with_maps, run, schema)
