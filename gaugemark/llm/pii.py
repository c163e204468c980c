"""Personal data in texts by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides.

1. Candidate spans are found in every whole text, wider than what will be kept: the base patterns of four kinds, and
   spellings that only may be personal data (addresses with "at" and "dot", IPv6, short cards, national telephone
   numbers, social security numbers, bank accounts, names).
2. Six labelers vote yes, no or nothing on each candidate: its form, its check digits or ranges, gazetteers (top-level
   domains, given names, calling codes, issuers, reserved networks), cue words before it, its variety of characters,
   and what touches it. Hashed words and shapes around the candidate are kept as features.
3. Spark counts the distinct vote patterns of each kind over all documents (at most 3 ** 6 a kind). From these
   counts expectation-maximisation estimates, for each kind, how often a labeler says yes on personal data and
   on other spans, and with it every pattern's probability. Of check digits this is known and not estimated.
4. A logistic classifier over votes and features learns these probabilities from a bounded sample: of each kind
   the ``LEARN_SPANS`` candidates with the smallest digests. It decides on every candidate of every document.

Spans of the base patterns stay whatever the classifier says. Another span stays if its probability is ``LEAST`` or more
and it overlaps no base span; of such spans that overlap, the first one stays, then the longer one.

Finders, whatever the text, take time linear in it: runs are found once, and patterns look at bounded places or never back.

Defined cases: a null or empty text gives no spans; rows that repeat an id are judged one by one and equal texts
alike; without any candidate nothing is learned; empty table, no rows; further columns are ignored.
Positions count code points, the end is exclusive.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import release, text_blocks
from .common import materialise, own_name, ship

BASE, KINDS = ("email", "ip", "card", "phone"), ("email", "ip", "card", "phone", "iban", "name", "ssn")
LABELERS = ("form", "check", "gazetteer", "cue", "variety", "edges")
NO, YES, NONE = 0, 1, 2
#: Check digits are known labelers: other digits pass them one time in 10 and one in 97. kind -> P(yes) on others and on personal data.
CHECK_DIGITS = {"card": (1 / 10, 1 - 1e-5), "iban": (1 / 97, 1 - 1e-5)}
LEARN_SPANS, FEATURES, LEAST, BLOCK_BYTES = 4000, 1 << 12, 0.5, 4 << 20

# What the gazetteers know.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io dev app me co uk de fr es it nl be ch at pl pt se no fi dk ie br ar mx cl us ca au nz jp cn in ru eu".split())
CALLING_CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 351 352 353 354 358 380 420 421 971 972".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[4-68]|30|35|6011|65|62")
ACCOUNT_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
GIVEN_NAMES = frozenset("Adam Alice Andreas Anna Antonio Barbara Bernard Brian Camille Carlos Catherine Charles Charlotte Christine Claire Daniel David Diego Dietrich Elena Elisabeth Emily Emma Enrique Eric Fernando Francesca Frank François Friedrich Gabriel George Giulia Gustav Hannah Heinrich Helen Henry Hugo Ingrid Isabel Jacques James Javier Jean Jennifer Johann Johanna John Jorge Joseph José Juan Julia Karl Katharina Kevin Klaus Laura Linda Lisa Louis Luca Lucía Luis Manuel Marco Marcel Margaret Maria Marie Martin Mary María Matthias Michael Miguel Monika Nicolas Olivia Pablo Patricia Paul Paula Pedro Peter Philippe Pierre Rachel Richard Robert Rosa Sandra Sarah Sofia Sophie Stefan Stephen Susan Sylvie Thomas Ursula Victoria William Wolfgang Yvonne".split())
TITLES = frozenset("mr mrs ms miss dr prof herr frau señor señora sr sra monsieur madame mme".split())
CUES = {
    "email": frozenset("email e-mail mail mailto contact write correo courriel adresse".split()),
    "ip": frozenset("ip address host from client login server adresse dirección".split()),
    "card": frozenset("card visa mastercard credit debit amex karte tarjeta carte payment".split()),
    "phone": frozenset("phone tel telephone mobile cell call fax telefon teléfono téléphone ring".split()),
    "iban": frozenset("iban account konto cuenta compte bank".split()),
    "name": frozenset("name by signed dear author patient customer sincerely regards".split()) | TITLES,
    "ssn": frozenset("ssn social security".split()),
}
COUNTER_CUES = frozenset("version v ver build release isbn issn order invoice ticket serial part no. nr figure page chapter section revision commit doi token key id".split())

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_AT = re.compile(r"[ ]?[\[(][Aa][Tt][\])][ ]?|[ ]at[ ]")
_LOCAL_END, _SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z"), re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?[\[(][Dd][Oo][Tt][\])] ?| dot )[A-Za-z0-9-]{1,63}){1,4}(?![A-Za-z0-9-])")
_ZONE = re.compile(r"[0-9+(][0-9 ().+/-]*")  # holds every number; nothing that a pattern below takes goes on outside it
_QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NATIONAL = re.compile(r"(?<![0-9+.])(?:\([0-9]{2,5}\)|[0-9]{2,5})[ ./-]?[0-9]{2,5}(?:[ ./-][0-9]{2,5}){1,3}(?![0-9])")
_SOCIAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SIX = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}")
_CAPITALS = re.compile(r"[A-ZÀ-Þ][a-zß-ÿ]++(?: [A-ZÀ-Þ][a-zß-ÿ]++)++")
_HEX = frozenset("0123456789abcdefABCDEF:")
_WORD = re.compile(r"[^\W_]+\.?|@")


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int, bool]]:
    free = 0  # where the next span may begin
    at = text.find("@")
    while at >= 0:
        local = text[free:at]
        start = free + len(local.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        free = found.end() if found else at + 1
        if found:
            yield start, free, True
        at = text.find("@", free)
    if " at " in text or "(" in text or "[" in text:
        for m in _AT.finditer(text):
            head = _LOCAL_END.search(text[max(0, m.start() - 64) : m.start()])
            tail = _SPELT.match(text, m.end())
            if head and tail:
                yield m.start() - len(head[0]), tail.end(), False


def _numbers(text: str) -> Iterator[tuple[str, int, int, bool]]:
    for zone in _ZONE.finditer(text):
        a, b = zone.span()
        if b - a < 7:
            continue
        for m in _QUAD.finditer(text, a, b):
            yield "ip", m.start(), m.end(), all(map(octet, m[0].split(".")))
        for m in _CHAIN.finditer(text, a, b):
            digits = digits_of(m[0])
            if 12 <= len(digits) <= 19:
                yield "card", m.start(), m.end(), len(digits) >= 16 and luhn(digits)
        for m in _PLUS.finditer(text, a, b):
            if 8 <= len(digits_of(m[0])) <= 15:
                yield "phone", m.start(), m.end(), True
        for m in _SOCIAL.finditer(text, a, b):
            yield "ssn", m.start(), m.end(), False
        for m in _NATIONAL.finditer(text, a, b):
            if 9 <= len(digits_of(m[0])) <= 13 and not _SOCIAL.fullmatch(m[0]):
                yield "phone", m.start(), m.end(), False
    for zone in re.finditer(r"[A-Z]{2}[0-9]{2}[ A-Z0-9]", text):
        if (zone.start() == 0 or not text[zone.start() - 1].isalnum()) and (m := _ACCOUNT.match(text, zone.start())):
            yield "iban", m.start(), m.end(), False


def _sixes(text: str) -> Iterator[tuple[int, int, bool]]:
    at, free = text.find(":"), 0
    while at >= 0:
        start = at
        while start > max(free, at - 5) and text[start - 1] in _HEX:
            start -= 1
        m = _SIX.match(text, start)
        whole = m and (start == 0 or text[start - 1] not in _HEX and not text[start - 1].isalnum()) and (m.end() == len(text) or text[m.end()] not in _HEX)
        if whole and len(m[0]) >= 8:
            yield m.start(), m.end(), False
        free = m.end() if whole else at + 1
        at = text.find(":", free)


def _names(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _CAPITALS.finditer(text):
        words = [(w.start(), w.end(), w[0]) for w in re.finditer(r"[^ ]+", m[0])]
        titled = _words_before(text, m.start(), 1)
        for n, (a, _, w) in enumerate(words[:-1]):
            title = (titled[-1] if titled else "") if n == 0 else words[n - 1][2].lower()
            if w in GIVEN_NAMES or title.strip(".") in TITLES:
                yield m.start() + a, m.start() + words[n + 1][1], False
                break


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) of every candidate of a text, by kind and start; what overlaps a base span is none."""
    found = [(KINDS.index(k), a, b, base) for k, a, b, base in _numbers(text)]
    found += [(KINDS.index("email"), *x) for x in _emails(text)]
    if ":" in text:
        found += [(KINDS.index("ip"), *x) for x in _sixes(text)]
    found += [(KINDS.index("name"), *x) for x in _names(text)]
    merged: list[list[int]] = []  # what base spans cover
    for _, a, b, base in sorted(found, key=lambda x: x[1]):
        if base and merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        elif base:
            merged.append([a, b])
    ends = [b for _, b in merged]

    def free(a: int, b: int) -> bool:
        at = bisect_right(ends, a)
        return at == len(merged) or merged[at][0] >= b

    return sorted(x for x in found if x[3] or free(x[1], x[2]))


def _words_before(text: str, start: int, n: int) -> list[str]:
    return [w.lower() for w in _WORD.findall(text[max(0, start - 48) : start])[-n:]]


def _words_after(text: str, end: int, n: int) -> list[str]:
    return [w.lower() for w in _WORD.findall(text[end : end + 48])[:n]]


def _ruled(ok: bool | None) -> int:
    return NONE if ok is None else int(ok)


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """What each of LABELERS says on a candidate."""
    span, digits = text[start:end], digits_of(text[start:end])
    form = check = known = None
    if kind == "email":
        form = True if base else None
        known = re.split(r"[ .\])]+", span.lower())[-1] in TOP_DOMAINS or None
    elif kind == "ip" and "." in span:
        parts = span.split(".")
        form = not any(len(p) > 1 and p[0] == "0" for p in parts)
        check = base
        known = base and not (int(parts[0]) in (0, 10, 127) or int(parts[0]) >= 224 or parts[:2] == ["192", "168"])
    elif kind == "ip":
        form, known = span.count(":") == 7 or None, not span.lower().startswith(("fe80", "ff", "0:", "::"))
    elif kind == "card":
        form = bool(re.fullmatch(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}", span))
        check = luhn(digits) and len(digits) >= 13
        known = bool(ISSUERS.match(digits))
    elif kind == "phone":
        form = span[0] in "+(" or bool(re.fullmatch(r"[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}", span))
        check = 9 <= len(digits) <= 13
        known = digits.startswith(CALLING_CODES) or None if span[0] == "+" else None
    elif kind == "iban":
        plain = span.replace(" ", "")
        check = int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
        form = known = ACCOUNT_LENGTHS.get(plain[:2]) == len(plain)
    elif kind == "ssn":
        form, check = True, digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    else:
        known = span.split(" ")[0] in GIVEN_NAMES or None
    before = _words_before(text, start, 4)
    cue = True if CUES[kind].intersection(w.strip(".") for w in before) else False if COUNTER_CUES.intersection(before) else None
    variety = len(set(digits)) >= min(4, len(digits) // 2) if kind in ("card", "phone", "ssn", "iban") else len(set(span)) >= 4
    left, right = text[start - 1 : start], text[end : end + 1]
    edges = not (left.isalnum() or right.isalnum() or left in ("_", "=", "#", "/") and left != "")
    return tuple(map(_ruled, (form, check, known, cue, variety, edges)))


def features(text: str, kind: str, start: int, end: int, said: tuple[int, ...]) -> list[int]:
    """Hashed features of a candidate, always equally many: votes, shape, length, and the words around it."""
    span = text[start:end]
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"{min(len(m[0]), 16)}n", span[:64]))
    words = [*_words_before(text, start, 2), "", ""][:2] + [*_words_after(text, end, 2), "", ""][:2]
    of = [f"{n}{v}" for n, v in zip(LABELERS, said, strict=True)] + ["all", f"s{shape}", f"l{min(len(span) // 4, 16)}", f"<{text[start - 1 : start]}", f">{text[end : end + 1]}"]
    of += [f"w{i}{w}" for i, w in enumerate(words)]
    return [zlib.crc32(f"{kind}|{f}".encode()) % FEATURES for f in of]


def packed(said: tuple[int, ...]) -> int:
    return sum(v * 3**i for i, v in enumerate(said))


def unpacked(code: int) -> tuple[int, ...]:
    return tuple(code // 3**i % 3 for i in range(len(LABELERS)))


def reliabilities(counts: dict[int, int], known: dict[str, tuple[float, float]] = {}, rounds: int = 500) -> tuple[np.ndarray, dict[int, float]]:  # noqa: B006
    """EM over the vote patterns of one kind: P(yes | class) of each labeler (labelers x 2), and each pattern's probability.

    A labeler that says nothing gives no evidence. One vote in ten is that of a labeler that is right 85 times in 100;
    that keeps the classes in their places at every size of input. Labelers in ``known`` keep what is said there.
    """
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    said = np.array([unpacked(c) for c in codes]).reshape(len(codes), len(LABELERS))
    yes, given = said == YES, said != NONE
    told = (given * n[:, None]).sum(axis=0)
    prior = np.array([0.15, 0.85])
    trust, share = np.array([known.get(x, prior) for x in LABELERS], float), 0.5
    fixed = [LABELERS.index(x) for x in known]
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + (np.where(yes, np.log(trust[:, 1] / trust[:, 0]), np.log((1 - trust[:, 1]) / (1 - trust[:, 0]))) * given).sum(axis=1)
        q = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        before = trust
        weight = np.stack([(1 - q) * n, q * n])
        agreed = np.stack([(w[:, None] * yes).sum(axis=0) for w in weight], axis=1)
        all_ = np.stack([(w[:, None] * given).sum(axis=0) for w in weight], axis=1)
        extra = 0.1 * told[:, None] + 1
        trust = np.clip((agreed + extra * prior) / (all_ + extra), 1e-4, 1 - 1e-4)
        trust[fixed] = before[fixed]
        share = float(np.clip((1 + weight[1].sum()) / (2 + n.sum()), 1e-4, 1 - 1e-4))
        if np.abs(trust - before).max(initial=0) < 1e-9:
            break
    return trust, dict(zip(codes, q.tolist(), strict=True)) if codes else {}


def learned(at: np.ndarray, targets: np.ndarray, rounds: int = 300, l2: float = 1e-4) -> np.ndarray:
    """Weights of a logistic classifier over hashed features by full-batch Adam; targets are probabilities."""
    w, m, v = np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(FEATURES)
    for step in range(1, rounds + 1 if len(at) else 1):
        p = 1 / (1 + np.exp(-np.clip(w[at].sum(axis=1), -50, 50)))
        grad = np.bincount(at.ravel(), np.repeat(p - targets, at.shape[1]), FEATURES) / len(at) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


_CANDIDATE = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.list_(pa.int32()))])
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and candidates: every candidate of the text with its votes and features."""
    ship(docs.sparkSession)
    column = own_name("text", [id_col])
    only = docs.select(F.col(id_col).alias(id_col), F.col(text).alias(column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_blocks(batches, column, BLOCK_BYTES):
            rows = []
            for value in table.column(column):
                whole, row = value.as_py() or "", []
                for kind, start, end, base in candidates(whole):
                    said = votes(whole, KINDS[kind], start, end, base)
                    row.append((kind, start, end, base, packed(said), features(whole, KINDS[kind], start, end, said)))
                rows.append([dict(zip(("kind", "start", "end", "base", "votes", "features"), x, strict=True)) for x in row])
            yield pa.record_batch([table.column(id_col).combine_chunks(), pa.array(rows, pa.list_(_CANDIDATE))], names=[id_col, "candidates"])
            del table, rows
        release()

    kind = f"`{id_col}` {only.schema[id_col].dataType.simpleString()}, candidates array<struct<kind:int,start:bigint,`end`:bigint,base:boolean,votes:int,features:array<int>>>"
    return only.mapInArrow(run, kind)


class SpanModel:
    """Reliabilities by kind (labelers x (no, yes)) and the weights of the span classifier."""

    def __init__(self, trust: dict[str, np.ndarray], weights: np.ndarray):
        self.trust, self.weights = trust, weights

    def scores(self, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[at].sum(axis=1), -50, 50)))


def train(found: DataFrame, id_col: str = "doc_id", learn_spans: int = LEARN_SPANS) -> SpanModel:
    """From all candidates the counts of vote patterns, from a bounded sample of each kind the classifier."""
    spans = found.select(F.col(id_col).cast("string").alias("id"), F.explode("candidates").alias("c")).select("id", "c.*")
    counts: dict[int, dict[int, int]] = {k: {} for k in range(len(KINDS))}
    for r in spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect():  # at most 7 x 3 ** 6 rows
        counts[r["kind"]][r["votes"]] = r["n"]
    trust, targets, at = {}, [], []
    digest = F.xxhash64("id", "start", "end", "votes", "features")
    for k, of in counts.items():
        trust[KINDS[k]], posterior = reliabilities(of, {"check": CHECK_DIGITS[KINDS[k]]} if KINDS[k] in CHECK_DIGITS else {})
        if of:
            sample = spans.where(F.col("kind") == k).select("votes", "features", digest.alias("d")).orderBy("d", "votes").limit(learn_spans).collect()
            targets += [posterior[r["votes"]] for r in sample]
            at += [r["features"] for r in sample]
    return SpanModel(trust, learned(np.array(at, np.int64), np.array(targets)))


def standing(found: list[dict], scores: list[float], least: float = LEAST) -> list[dict]:
    """All base spans, and of the others, which overlap none of these, those that score enough and come first."""
    out, reach = [(c, s) for c, s in zip(found, scores, strict=True) if c["base"]], 0
    others = [(c, s) for c, s in zip(found, scores, strict=True) if not c["base"] and s >= least]
    for c, score in sorted(others, key=lambda x: (x[0]["start"], -x[0]["end"], x[0]["kind"])):
        if c["start"] >= reach:
            out.append((c, score))
            reach = c["end"]
    return [{"kind": KINDS[c["kind"]], "start": c["start"], "end": c["end"], "base": c["base"], "score": s} for c, s in sorted(out, key=lambda x: (x[0]["kind"], x[0]["start"], x[0]["end"]))]


def decide(found: DataFrame, model: SpanModel, id_col: str = "doc_id", least: float = LEAST) -> DataFrame:
    """id and spans (kind, start, end, base, score), by kind and start, from a table of candidates."""
    weights = found.sparkSession.sparkContext.broadcast(model.weights)  # FEATURES doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SpanModel({}, weights.value)
        for batch in batches:
            rows = batch.column("candidates").to_pylist()
            flat = [c["features"] for row in rows for c in row]
            scores = iter(model.scores(np.array(flat, np.int64)).tolist() if flat else ())
            out = [standing(row, [next(scores) for _ in row], least) for row in rows]
            yield pa.record_batch([batch.column(id_col), pa.array(out, pa.list_(_SPAN))], names=[id_col, "spans"])
        release()

    kind = f"`{id_col}` {found.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,`end`:bigint,base:boolean,score:double>>"
    return found.mapInArrow(run, kind)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text: str = "text", learn_spans: int = LEARN_SPANS, least: float = LEAST) -> DataFrame:
    """id and spans of personal data of every document; trained on the very documents, without labels."""
    found = materialise(find_candidates(docs, id_col, text))
    return decide(found, train(found, id_col, learn_spans), id_col, least)


def digests(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, counts of base spans by kind, their digest, and all spans as kind:start:end joined by commas."""
    joined = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return spans.select(id_col, *map(count, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
