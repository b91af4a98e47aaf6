"""Personal data: four rules, and a linear-chain conditional random field over word shapes.

The rules find e-mail addresses, IPv4 addresses, card and phone numbers. The field is trained from a
small labelled table of texts with marked spans, and adds what the rules miss: local phone numbers,
spelled-out addresses and the like. Its features are the shapes of a token and of the two on either
side; its tags say which kind a token begins or continues. Its tags are those of the best path over the
whole text. Most of a text is settled before Viterbi: a run of tagged tokens scores at most the sum of its
tokens' bounds, so a token that is in no run with a sum above zero has no tag. Only the runs that are left
are decoded, in numpy batches, and of them only those with what plausible() asks for. Tokens, shapes and
bounds are worked out for all texts of a slice at once.

Defined cases: null text is empty and has no spans; a predicted span that meets a rule's span is left
out, so rules' spans stay as they are; repeated rows are taken one by one; null ids are kept. Other
input columns are not carried. Time is linear in a text's length, whatever it is made of.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, with_id

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def rule_spans(text: str) -> list[Span]:
    """Spans of the rules by kind, then start. Each kind's matches are leftmost and do not overlap; those
    that fail the kind's check are dropped."""
    out: list[Span] = []
    if "@" in text:
        done, run = 0, None
        at = text.find("@")
        locals_ = _LOCAL.finditer(text)
        while at >= 0:
            while run is None or run.end() < at:  # the run of local characters that ends at this sign
                if (run := next(locals_, None)) is None:
                    break
            if run is None:
                break
            if run.end() == at and max(done, run.start()) < at and (domain := _DOMAIN.match(text, at + 1)):
                out.append((0, max(done, run.start()), domain.end()))
                done = domain.end()
            at = text.find("@", at + 1)
    if not re.search("[0-9]", text):
        return out
    for m in _CHAIN.finditer(text):
        if m[0].count(".") >= 3:
            parts, at = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                    out.append((1, at, end))
                at = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# the field

TAGS = 1 + 2 * len(KINDS)  # 0: none; 1 + 2k: kind k begins; 2 + 2k: it goes on
REACH = 2
#: Classes of characters. A token is a run of letters, a run of the digits 0 to 9, or any one character that is no blank.
LETTER, DIGIT, BLANK, OTHER = range(4)
#: Tokens that are decoded at once, about, and tokens whose bounds are worked out at once.
DECODED, BOUNDED = 1 << 17, 1 << 16
#: Codes of shapes: digits by their number, letters by case and length, signs by character, then the words
#: that are shapes of their own: of at most WORD_CHARS letters, all below WORD_LETTERS.
SIGN_CODE, WORD_CODE, WORD_CHARS, WORD_LETTERS = 20, 150, 5, 4096


@lru_cache(1)
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, lower case (itself where that is not one character) and whether it is upper case, of each character."""
    every = [chr(i) for i in range(sys.maxunicode + 1)]
    kind = np.array([LETTER if c.isalpha() else BLANK if c.isspace() else OTHER for c in every], np.uint8)
    kind[48:58] = DIGIT
    lower = np.array([ord(low) if len(low := c.lower()) == 1 else i for i, c in enumerate(every)], np.uint32)
    return kind, lower, np.array([c.isupper() for c in every])


@dataclass
class Tokens:
    """The tokens of many texts: places within their texts, the text's number, and a code for each's shape."""

    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    code: np.ndarray
    hint: np.ndarray  # digits, an at-sign or the word "at": every plausible span holds one


def packed(word: str) -> int:
    """A short word as a number."""
    out = 0
    for c in word.ljust(WORD_CHARS, "\0"):
        out = out * WORD_LETTERS + ord(c)
    return out


def tokens(texts: list[str], words: np.ndarray) -> Tokens:
    """words: packed words that are shapes of their own, in order."""
    kinds, lower, upper = characters()
    chars = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), "<u4")
    kind = kinds[chars]
    change = kind[1:] != kind[:-1]
    single = kind == OTHER
    start = np.flatnonzero((kind != BLANK) & (np.append(True, change) | single))
    end = np.flatnonzero((kind != BLANK) & (np.append(change, True) | single)) + 1
    first = np.cumsum([0, *(len(x) + 1 for x in texts)])
    owner = np.searchsorted(first, start, "right") - 1
    spaced = (start > first[owner]) & (kind[start - 1] == BLANK)
    length, head, own = end - start, chars[start], kind[start]
    code = np.where(own == DIGIT, np.minimum(length, 9), SIGN_CODE + np.where(head < 128, head, ord("?")))
    letters = own == LETTER
    code[letters] = 10 + 4 * upper[head[letters]] + np.searchsorted([2, 4, 8], length[letters], "right")
    short = np.flatnonzero(letters & (length <= WORD_CHARS))
    name, known = np.zeros(len(short), np.int64), np.ones(len(short), bool)
    for j in range(WORD_CHARS):
        inside = length[short] > j
        c = np.where(inside, lower[chars[np.minimum(start[short] + j, len(chars) - 1)]], 0).astype(np.int64)
        known &= c < WORD_LETTERS
        name = name * WORD_LETTERS + np.minimum(c, WORD_LETTERS - 1)
    at = np.minimum(np.searchsorted(words, name), max(0, len(words) - 1))
    named = known & (words[at] == name) if len(words) else np.zeros(len(short), bool)
    code[short[named]] = WORD_CODE + at[named]
    hint = (own == DIGIT) | (head == ord("@"))
    hint[short[known & (name == packed("at"))]] = True
    return Tokens(start - first[owner], end - first[owner], owner, 2 * code + spaced, hint)


@dataclass
class Field:
    words: np.ndarray  # packed, in order
    shapes: np.ndarray  # the number of each code's shape; 0: unknown, 1: outside
    emit: np.ndarray  # (2 * REACH + 1, shapes, TAGS)
    step: np.ndarray  # (TAGS, TAGS), of a tag and the next

    def ids(self, text: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The shapes and places of one text's tokens."""
        found = tokens([text], self.words)
        return self.shapes[found.code], list(zip(found.start.tolist(), found.end.tolist(), strict=True))

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Emission scores of padded rows of shapes: (rows, tokens, TAGS)."""
        wide = np.pad(ids, ((0, 0), (REACH, REACH)), constant_values=1)
        return sum(self.emit[o][wide[:, o : o + ids.shape[1]]] for o in range(2 * REACH + 1))

    def viterbi(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each row of shapes."""
        return self.best([self.scores(x[None])[0] for x in rows])

    def best(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each row of emission scores; rows of about the same length are decoded together."""
        out: list[np.ndarray] = [None] * len(rows)
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to + 1 - at) * len(rows[order[to]]) <= DECODED:
                to += 1
            part, at = order[at:to], to
            lengths = np.array([len(rows[i]) for i in part])
            emit = np.zeros((len(part), int(lengths.max(initial=0)), TAGS))
            for r, i in enumerate(part):
                emit[r, : lengths[r]] = rows[i]
            best, back = emit[:, 0], []
            for t in range(1, emit.shape[1]):
                ways = best[:, :, None] + self.step[None]
                come = ways.argmax(axis=1)
                new = np.take_along_axis(ways, come[:, None], 1)[:, 0] + emit[:, t]
                live = (t < lengths)[:, None]
                best, come = np.where(live, new, best), np.where(live, come, np.arange(TAGS))
                back.append(come.astype(np.int8))
            tag = best.argmax(axis=1)
            path = [tag]
            for come in reversed(back):
                tag = np.take_along_axis(come, tag[:, None], 1)[:, 0]
                path.append(tag)
            path = np.stack(path[::-1], axis=1)
            for r, i in enumerate(part):
                out[i] = path[r, : lengths[r]]
        return out

    def bounds(self, wide: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most that each token's best tag can add to a path over having none, after a tagged token and
        after one without a tag. wide: shapes with REACH more on either side; first, last: the tokens that
        begin and end a text."""
        step = self.step - self.step[0, 0]
        over = [x[:, 1:] - x[:, :1] for x in self.emit]
        within, fresh = np.empty(len(wide) - 2 * REACH), np.empty(len(wide) - 2 * REACH)
        for a in range(0, len(within), BOUNDED):
            b = min(len(within), a + BOUNDED)
            gain = sum(over[o][wide[a + o : b + o]] for o in range(2 * REACH + 1))
            within[a:b] = (gain + step[1:, 1:].max(axis=0)).max(axis=1)
            fresh[a:b] = np.where(first[a:b], gain.max(axis=1), (gain + step[0, 1:]).max(axis=1))  # no step leads to a text's first token
        within[last] -= self.leave()
        fresh[last] -= self.leave()
        return within, fresh

    def leave(self) -> float:
        """The most that the step from a tag to none adds over that from none to none; a text's last token has no such step."""
        return float((self.step[1:, 0] - self.step[0, 0]).max())

    def runs(self, within: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of tokens that may have a tag on a best path, from their bounds: a
        token is in one where some stretch around it gains by its tags."""
        total = np.cumsum(within)
        before = total - within
        ending = total - np.minimum.accumulate(before - fresh + within)
        starting = np.maximum.accumulate(total[::-1])[::-1] - total
        may = np.concatenate([[False], ending + starting + self.leave() > -1e-4, [False]])
        edge = np.flatnonzero(may[1:] != may[:-1])
        return edge[::2], edge[1::2]


def decoded(field: Field, texts: list[str]) -> list[list[Span]]:
    """The plausible spans on the best path of each text."""
    out: list[list[Span]] = [[] for _ in texts]
    found = tokens(texts, field.words)
    if not len(found.start):
        return out
    # all texts in one line, REACH outside tokens before and after each
    place = np.arange(len(found.owner)) + REACH * (found.owner + 1)
    size = len(place) + REACH * (len(texts) + 1)
    wide = np.ones(size + 2 * REACH, np.int64)
    wide[REACH + place] = field.shapes[found.code]
    token = np.full(size, -1)
    token[place] = np.arange(len(place))
    first, last, change = np.zeros(size, bool), np.zeros(size, bool), found.owner[1:] != found.owner[:-1]
    first[place[np.append(True, change)]] = last[place[np.append(change, True)]] = True
    within, fresh = field.bounds(wide, first, last)
    within[token < 0] = fresh[token < 0] = -1e7  # no run goes from one text to another
    hints = np.zeros(size + 1, np.int64)
    hints[place + 1] = found.hint
    hints = np.cumsum(hints)
    start, end = field.runs(within, fresh)
    some = hints[end] > hints[start]
    held, rows = [], []
    for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True):
        low, high = a - int(token[a - 1] >= 0), b + int(token[b] >= 0)  # the tokens beside a run have no tag
        row = sum(field.emit[o][wide[low + o : high + o]] for o in range(2 * REACH + 1))
        row[: a - low, 1:] = row[len(row) - (high - b) :, 1:] = -1e12
        held.append(token[low:high])
        rows.append(row)
    for at, tags in zip(held, field.best(rows), strict=True):
        if tags.any():
            i = int(found.owner[at[0]])
            places = list(zip(found.start[at].tolist(), found.end[at].tolist(), strict=True))
            out[i] += [(kind, a, b) for kind, a, b in spans_of(tags, places) if plausible(kind, texts[i][a:b])]
    return out


def train(labelled: list[tuple[str, list[Span]]], rounds: int = 80, rate: float = 0.2, decay: float = 1e-3) -> Field:
    """Fits the field to marked texts by gradient steps on the likelihood (forward and backward sums)."""
    counts = Counter(w for text, _ in labelled for w in re.findall(r"[^\W\d_]+", text.lower()))
    words = np.array(sorted(packed(w) for w, n in counts.items() if n >= 8 and len(w) <= WORD_CHARS and max(map(ord, w)) < WORD_LETTERS), np.int64)
    codes = np.unique(tokens([text for text, _ in labelled], words).code)
    shapes = np.zeros(2 * (WORD_CODE + len(words)), np.int64)
    shapes[codes] = np.arange(len(codes)) + 2
    field = Field(words, shapes, np.zeros((2 * REACH + 1, len(codes) + 2, TAGS)), np.zeros((TAGS, TAGS)))
    rows, places = zip(*(field.ids(text) for text, _ in labelled), strict=True)
    lengths = np.array([len(x) for x in rows])
    ids, gold = np.ones((len(rows), lengths.max()), np.int64), np.zeros((len(rows), lengths.max()), np.int64)
    for r, ((_, spans), where) in enumerate(zip(labelled, places, strict=True)):
        ids[r, : lengths[r]] = rows[r]
        for kind, start, end in spans:
            for t, (a, b) in enumerate(where):
                if start <= a and b <= end:
                    gold[r, t] = (1 if a == start else 2) + 2 * kind
    live = np.arange(ids.shape[1]) < lengths[:, None]
    # unknown shapes speak for no kind: copies of the rows, with some of what is outside made unknown, and rows of nothing else
    rng = np.random.default_rng(1)
    blurred = np.where(live & (gold == 0) & (rng.random(ids.shape) < 0.4), 0, ids)
    unknown = np.where(live, 0, 1)
    ids, gold, live, lengths = np.concatenate([ids, blurred, unknown]), np.concatenate([gold, gold, np.zeros_like(gold)]), np.concatenate([live] * 3), np.concatenate([lengths] * 3)
    wide = np.pad(ids, ((0, 0), (REACH, REACH)), constant_values=1)
    both = live[:, 1:]
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (field.emit, field.step)]
    for k in range(1, rounds + 1):
        emit = field.scores(ids)
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for t in range(1, ids.shape[1]):
            ahead[:, t] = np.where(live[:, t, None], _sum_log(ahead[:, t - 1, :, None] + field.step, 1) + emit[:, t], ahead[:, t - 1])
        for t in range(ids.shape[1] - 2, -1, -1):
            behind[:, t] = np.where(both[:, t, None], _sum_log(field.step[None] + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0)
        whole = _sum_log(ahead[:, -1], 1)
        single = np.exp(ahead + behind - whole[:, None, None]) * live[..., None]
        pair = np.exp(ahead[:, :-1, :, None] + field.step + (emit + behind)[:, 1:, None, :] - whole[:, None, None, None]) * both[..., None, None]
        seen = np.eye(TAGS)[gold] * live[..., None]
        slope = (seen - single) / len(ids)
        emit_slope = np.zeros_like(field.emit)
        for o in range(2 * REACH + 1):
            shapes = wide[:, o : o + ids.shape[1]].ravel()
            for tag in range(TAGS):
                emit_slope[o, :, tag] = np.bincount(shapes, slope[..., tag].ravel(), emit_slope.shape[1])
        step_slope = (np.einsum("nti,ntj->ij", seen[:, :-1] * both[..., None], seen[:, 1:]) - pair.sum(axis=(0, 1))) / len(ids)
        for x, g, m in ((field.emit, emit_slope, moments[0]), (field.step, step_slope, moments[1])):
            g = g - decay * x / len(ids)
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x += rate * (m[0] / (1 - 0.9**k)) / (np.sqrt(m[1] / (1 - 0.99**k)) + 1e-8)
    return field


def _sum_log(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def spans_of(tags: np.ndarray, places: list[tuple[int, int]]) -> list[Span]:
    out: list[list[int]] = []
    last = 0
    for tag, (a, b) in zip(tags.tolist(), places, strict=True):
        if tag and tag % 2:
            out.append([(tag - 1) // 2, a, b])
        elif tag and out and last and (last - 1) // 2 == (tag - 1) // 2:
            out[-1][2] = b
        last = tag if not tag or tag % 2 or (last and (last - 1) // 2 == (tag - 1) // 2) else 0
    return [tuple(x) for x in out]


def plausible(kind: int, span: str) -> bool:
    """What a span of the kind holds at least."""
    numbers = re.findall("[0-9]+", span)
    digits = sum(map(len, numbers))
    if kind == 0:
        return bool(re.search(r"@|\Wat\W", span, re.IGNORECASE)) and bool(re.search(r"\.|\Wdot\W", span, re.IGNORECASE))
    if kind == 1:
        return len(numbers) == 4 and span.count(".") == 3 and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in numbers)
    return 16 <= digits <= 19 and luhn("".join(numbers)) if kind == 2 else 10 <= digits <= 15


_MARKED = re.compile("<(email|ip|card|phone)>(.*?)</\\1>")


def unmarked(text: str) -> tuple[str, list[Span]]:
    """A text with <kind>...</kind> marks, as plain text and spans."""
    out, spans, at = "", [], 0
    for m in _MARKED.finditer(text):
        out += text[at : m.start()]
        spans.append((KINDS.index(m[1]), len(out), len(out) + len(m[2])))
        out += m[2]
        at = m.end()
    return out + text[at:], spans


#: Forms of the kinds (# is a digit, a a letter) and sentences around them and around other numbers.
FORMS = {
    "email": ("aaaa.aa@aaaa.com", "aaa_##@aaaaa.aa.org", "aaaaa@aaaa.net", "aaaa (at) aaaaa.com", "aaa.aaaa [at] aaaa [dot] org", "a.aaaaa at aaaaaa dot net"),
    "ip": ("##.##.##.##", "1##.1##.#.##", "#.##.1##.#"),
    "card": ("4### #### #### ####", "5###-####-####-####", "4###############", "3### ###### ##### ####"),
    "phone": ("(###) ###-####", "###-###-####", "###.###.####", "+# (###) ###-####", "+## ## ########", "0## ### ## ## ##", "1-###-###-####"),
}
SENTENCES = ("Call {phone} or write to {email} today.", "tel {phone}", "Tel.: {phone}, fax {phone}", "my number is {phone} and more", "Ruf mich an unter {phone} bitte", "Appelez le {phone} pour en savoir plus.", "llame al {phone} ahora", "the card {card} was used", "Card: {card}", "pay by {card} of the bank", "mail {email}", "contact {email} for the list", "Schreib an {email} heute", "from {ip} to {ip}", "the host {ip} is down", "login of {email} at {ip}", "reach me: {email}, {phone}")
OTHERS = ("in 19## there were ## of them", "on 20##-0#-1# at 1#:## the end", "page ## of ###", "version #.##.# is out", "order no. ####### of 20##", "it costs ##.## or #,### in all", "ISBN 978-#-##-######-#", "a ratio of #.##### and ## percent", "the ##th of May 19##, ###,### people", "password=aaaa####aa####aa", "token ####aaaa########", "section #.#.# (see ##)", "room ###, floor ##", "score ##-## and ##:##", "und 20## waren es ## Leute", "see me at ## or at noon", "id ################## of ##")


def labelled_table(spark: SparkSession, each: int = 4, seed: int = 7) -> DataFrame:
    """The small labelled table: (text with marks), each form and sentence above `each` times."""
    rng = np.random.default_rng(seed)

    def filled(form: str) -> str:
        return "".join(str(rng.integers(1, 10)) if c == "#" else c for c in form)

    def worded(form: str) -> str:
        return re.sub("(?<![a-z])a+(?![a-z])", lambda m: "".join(map(chr, rng.integers(97, 123, len(m[0])))), form)

    rows = []
    for _ in range(each):
        for sentence in SENTENCES:
            rows.append(re.sub("{(.*?)}", lambda m: f"<{m[1]}>{filled(worded(str(rng.choice(FORMS[m[1]]))))}</{m[1]}>", sentence))
        for kind, forms in FORMS.items():
            rows += [f"and so on <{kind}>{filled(worded(x))}</{kind}> it goes" for x in forms]
        rows += [filled(x) for x in OTHERS]
    return spark.createDataFrame([(x,) for x in rows], "marked string")


def _scanned(batches: Iterator[pa.RecordBatch], field) -> Iterator[pa.RecordBatch]:
    field: Field = field.value
    for batch in slices(batches, "text"):
        texts = [x or "" for x in batch.column("text").to_pylist()]
        base = [rule_spans(x) for x in texts]
        found = [[*x, *((k, a, b) for k, a, b in more if not any(s < b and a < e for _, s, e in x))] for x, more in zip(base, decoded(field, texts), strict=True)]
        counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in range(len(KINDS))]
        digests = [hashlib.sha256(shown(x).encode()).hexdigest() for x in base]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *counts, pa.array(digests), pa.array([shown(x) for x in found])], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal_data(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone and base_sha256 (of the rules' spans), and spans (all of them)
    of every row. labelled: a small table of marked texts; it is collected for the training."""
    spark = docs.sparkSession
    labelled = labelled_table(spark) if labelled is None else labelled
    field = spark.sparkContext.broadcast(train([unmarked(r[0]) for r in labelled.collect() if r[0]]))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_scanned, field=field), with_id(docs, id_col, f"{counts}, base_sha256 string, spans string")).withColumnRenamed("id", id_col)
