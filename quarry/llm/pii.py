"""Personal data: base patterns with checks, and a linear-chain conditional random field that adds spans.

The field tags tokens from word shapes and cue words. It is trained from LABELLED below and decoded by Viterbi for all
runs of a batch at once. A tag needs a digit in its token: tokens without one are O, so the chain falls apart at them
and each run of tokens with digits is decoded by itself, exactly.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quarry.llm import common

KINDS = ("email", "ip", "card", "phone", "id")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Numbers joined by dots, taken whole, so that no place is looked at twice.
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_GAP = re.compile(r"[\x20\x09-\x0D]+")
_NEXT = re.compile(r"[\x20\x09-\x0D]*([^\x20\x09-\x0D]*)")
_BLANKS = " \t\n\x0b\x0c\r"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind; a match that fails its check is dropped."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:  # a local part ends at its @, so that the @ signs are the places to look at
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", start, done := m.end()))
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            if m[0].count(".") >= 3:
                out += _ips(m[0], m.start())
        for m in _CARD.finditer(text):
            if 14 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _ips(chain: str, start: int) -> list[tuple[str, int, int]]:
    """Of numbers joined by dots, each four that follow each other and are at most 255; a rest of fewer than four is none."""
    parts, out = chain.split("."), []
    ends = list(itertools.accumulate(len(x) + 1 for x in parts))
    for k in range(0, len(parts) - 3, 4):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in parts[k : k + 4]):
            out.append(("ip", start + (ends[k - 1] if k else 0), start + ends[k + 3] - 1))
    return out


TAGS = ("O", "B-phone", "I-phone", "B-id", "I-id")
#: The labelled table: tokens, with /p for a telephone number's and /s for an identity number's.
LABELLED = """
call me at (503)/p 555-2214/p today
my phone is 503-555-0187/p ok
phone: 212/p 555/p 0143/p or later
tel. 415.555.0102/p please
tel (030)/p 555-4417/p jetzt
mobile 617-555-0119/p thanks
reach us: (808)/p 555-0160/p anytime
fax 312-555-0171/p office
and call (206)/p 555/p 0134/p again
numéro 646-555-0198/p merci
telefon: 702/p 555/p 0122/p bitte
teléfono (305)/p 555-0155/p gracias
the cell 919-555-0108/p of
ssn 123-45-6789/s given
ssn: 219-09-9999/s on file
social security number 078-05-1120/s was
tax id 457-55-5462/s stated
the id 321-54-9876/s belongs
her ssn is 509-41-2235/s now
on 2024-05-06 at 10:30 we met
pages 12-14 and 20-25 of it
price 1,299.00 in total
order 4785380592391139 shipped
version 2.0. of the license
the score was 3-2 then
from 1999-2004 they stayed
room 555 on floor 12
it has 100 or 2000 parts
about 50 000 people came
in 2019 some 1500 left
token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" there
key a7f3-99d1-77aa-0b12 and
address 10.0.0.1 port 8080
id 9870157079875996 was used
call 5 times or 10 times
phone model 3310 from 2000
isbn 978-3-16-148410-0 book
at 12:45 on 03/04/2021 it
chapter 4 section 2.1 line 7
item 12-345-67 in stock
mail 19@mail5.example.com works
ratio 16-9 or 4-3 screens
call number 823.91 in list
"""
_TAG_OF = {"": "", "p": "phone", "s": "id"}


def table() -> list[tuple[list[str], list[int]]]:
    out = []
    for line in LABELLED.strip().split("\n"):
        tokens, tags, last = [], [], ""
        for x in line.split(" "):
            word, mark = (x[:-2], x[-1]) if x[-2:] in ("/p", "/s") else (x, "")
            kind = _TAG_OF[mark]
            tags.append(TAGS.index("O" if not kind else ("I-" if kind == last else "B-") + kind))
            tokens.append(word)
            last = kind
        out.append((tokens, tags))
    return out


def shape(token: str) -> str:
    """Runs of digits with their length (5 for more), letters as x or X, other characters themselves."""
    return "".join(f"d{min(5, len(m[0]))}" if m[1] else "X" if m[2] else "x" if m[3] else m[0] for m in re.finditer(r"([0-9]+)|([A-Z]+)|([^\W\d_]+)|(.)", token, re.S))


def word_before(text: str, at: int) -> str:
    """The word that ends before the blanks before `at`."""
    end = at
    while end and text[end - 1] in _BLANKS:
        end -= 1
    start = end
    while start and text[start - 1] not in _BLANKS:
        start -= 1
    return text[start:end]


def features(before: str, token: str, after: str) -> list[str]:
    bare = token.strip(".,;:!?\"'*#%&$|")
    cue = re.sub(r"\W+", "", before.lower())[:12]
    return ["1", "s=" + shape(bare), "n=" + str(min(20, sum(map(str.isdigit, bare)))), "w=" + cue, "p=" + shape(before.strip(".,;:"))[:12], "f=" + shape(after.strip(".,;:"))[:12]]


class Crf:
    """Weights of (feature, tag) and (tag, tag); tag 0 stands before and after each run."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), len(TAGS)))
        for i, row in enumerate(rows):
            for name in row:
                if (k := self.names.get(name)) is not None:
                    out[i] += self.emit[k]
        return out

    def decode(self, rows: list[list[str]], lengths: np.ndarray) -> np.ndarray:
        """The best tags of all runs, laid end to end, by Viterbi; runs of like length go together."""
        score, begin = self.scores(rows), np.cumsum(lengths) - lengths
        out = np.zeros(len(rows), np.int64)
        for n in np.unique(lengths):
            at = begin[lengths == n]
            best, back = self.move[0] + score[at], []
            for t in range(1, n):
                through = best[:, :, None] + self.move[None]
                back.append(through.argmax(axis=1))
                best = through.max(axis=1) + score[at + t]
            tag = (best + self.move[:, 0]).argmax(axis=1)
            out[at + n - 1] = tag
            for t in range(n - 1, 0, -1):
                tag = back[t - 1][np.arange(len(at)), tag]
                out[at + t - 1] = tag
        return out


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(labelled: list[tuple[list[str], list[int]]], steps: int = 250, decay: float = 0.02) -> Crf:
    """Maximum likelihood with a quadratic penalty by Adam, all sentences at once; the same weights each time."""
    rows = [[features(s[i - 1] if i else "", s[i], s[i + 1] if i + 1 < len(s) else "") for i in range(len(s))] for s, _ in labelled]
    names: dict[str, int] = {}
    for name in (x for s in rows for r in s for x in r):
        names.setdefault(name, len(names))
    K, T = len(TAGS), max(map(len, rows))
    X = np.zeros((len(rows), T, len(names)))
    Y, mask = np.zeros((len(rows), T), int), np.zeros((len(rows), T), bool)
    for i, (s, (_, tags)) in enumerate(zip(rows, labelled)):
        for t, r in enumerate(s):
            X[i, t, [names[x] for x in r]] = 1
        Y[i, : len(s)], mask[i, : len(s)] = tags, True
    digitless = np.array([[not (t < len(s) and any(map(str.isdigit, s[t]))) for t in range(T)] for s, _ in labelled])
    gold = np.eye(K)[Y] * mask[:, :, None]
    emit, move = np.zeros((len(names), K)), np.zeros((K, K))
    moments = [np.zeros_like(x) for x in (emit, emit, move, move)]
    S = np.arange(len(rows))
    last = mask.sum(axis=1) - 1
    gold_move = np.zeros((K, K))
    for s, (_, tags) in zip(rows, labelled):
        for a, b in zip([0, *tags], [*tags, 0]):
            gold_move[a, b] += 1
    for step in range(1, steps + 1):
        score = X @ emit
        score[:, :, 1:] -= 1e4 * digitless[:, :, None]
        A, B = np.zeros((len(rows), T, K)), np.zeros((len(rows), T, K))
        A[:, 0] = move[0] + score[:, 0]
        for t in range(1, T):
            A[:, t] = lse(A[:, t - 1, :, None] + move[None], 1) + score[:, t]
        Z = lse(A[S, last] + move[:, 0], 1)
        for t in range(T - 1, -1, -1):
            ahead = lse(move[None] + (score[:, t + 1] + B[:, t + 1])[:, None], 2) if t + 1 < T else np.zeros((len(rows), K))
            B[:, t] = np.where((last == t)[:, None], move[:, 0], ahead)
        P = np.exp(A + B - Z[:, None, None]) * mask[:, :, None]
        g_emit = np.einsum("stf,stk->fk", X, gold - P) - decay * emit
        g_move = gold_move.copy() - decay * move
        g_move[0] -= P[:, 0].sum(axis=0)
        g_move[:, 0] -= P[S, last].sum(axis=0)
        for t in range(1, T):
            pair = A[:, t - 1, :, None] + move[None] + (score[:, t] + B[:, t])[:, None] - Z[:, None, None]
            g_move -= (np.exp(pair) * mask[:, t, None, None]).sum(axis=0)
        for x, g, m, v in ((emit, g_emit, *moments[:2]), (move, g_move, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(names, emit, move)


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring tokens that hold a digit, as spans."""
    out, at = [], 0
    while m := _DIGIT.search(text, at):
        start = m.start()
        while start > 0 and not _SPACE.match(text[start - 1]):
            start -= 1
        end = g.start() if (g := _SPACE.search(text, m.start())) else len(text)
        if out and (gap := _GAP.match(text, out[-1][-1][1])) and gap.end() == start:
            out[-1].append((start, end))
        else:
            out.append([(start, end)])
        at = end
    return out


def added_spans(texts: list[str], model: Crf, base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """What the field finds in each text beyond the base spans: 7 to 15 digits for a phone, 9 for an id."""
    rows, lengths, where = [], [], []
    for i, text in enumerate(texts):
        for run in runs(text) if _DIGIT.search(text) else ():
            lengths.append(len(run))
            words = [text[a:b] for a, b in run]
            before = word_before(text, run[0][0])
            after = _NEXT.match(text, run[-1][1])[1]
            rows += [features(words[k - 1] if k else before, words[k], words[k + 1] if k + 1 < len(run) else after) for k in range(len(run))]
            where += [(i, a, b) for a, b in run]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not rows:
        return out
    tags = model.decode(rows, np.array(lengths))
    first = set(np.cumsum(lengths) - lengths)
    spans: list[list] = []
    for k, tag in enumerate(tags.tolist()):
        kind = TAGS[tag][2:]
        if kind and TAGS[tag][0] == "I" and spans and k not in first and spans[-1][3] == k - 1 and spans[-1][4] == kind:
            spans[-1][2:4] = [where[k][2], k]
        elif kind:
            spans.append([where[k][0], where[k][1], where[k][2], k, kind])
    starts = [[a for _, a, _ in own] for own in base]
    reach = [list(itertools.accumulate((b for _, _, b in own), max)) for own in base]
    for i, a, b, _, kind in spans:
        text = texts[i]
        while a < b and text[a] not in "(+0123456789":
            a += 1
        while b > a and text[b - 1] not in "0123456789":
            b -= 1
        digits = len(_NOT_DIGIT.sub("", text[a:b]))
        if (7 <= digits <= 15 if kind == "phone" else digits == 9) and not ((k := bisect.bisect_left(starts[i], b)) and reach[i][k - 1] > a):
            out[i].append((kind, a, b))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, *, replace: bool = False) -> DataFrame:
    """docs plus n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans and n_added; from column text alone.

    With replace, text is redacted too. Columns of the added names are replaced. Null or empty text: no spans, and a null
    text stays null. Offsets are code points. Repeated rows get equal results; spans with one start come in order of their kinds. A long text
    is read whole, in time that grows with its length. Empty table: empty result.
    """
    added = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    names = StructType.fromDDL(added).names
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(train(table()))

    def run(batches):
        model = shared.value
        for part in common.slices(batches):
            texts = common.text_column(part).to_pylist()
            base = [base_spans(x) for x in texts]
            more = added_spans(texts, model, base)
            every = [sorted(a + b, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) for a, b in zip(base, more)]
            columns = list(part.columns)
            if replace:
                k = part.schema.get_field_index("text")
                columns[k] = pa.array([None if not ok else redact(x, s) if s else x for x, s, ok in zip(texts, every, part.column(k).is_valid().to_pylist())], part.schema.field(k).type)
            counts = [pa.array([sum(s[0] == kind for s in own) for own in base], pa.int64()) for kind in KINDS[:4]]
            shas = pa.array([hashlib.sha256(joined(own).encode()).hexdigest() for own in base], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *counts, shas, pa.array(map(joined, every), pa.string()), pa.array(map(len, more), pa.int64())], [*part.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(added).fields]))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES = {"op6_personal_data": op6}
