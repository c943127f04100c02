"""Sentence boundaries across languages and scripts (problem 10): a semi-Markov search over whole spans.

Empty lines and list lines cut a text into blocks. Within a block every closing mark is a possible boundary, the
unlikely ones too, and dynamic programming picks the sequence of spans whose scores sum to most. A span is scored as a whole:

- closing: its last word, stop and closing marks (an abbreviation or a number counts against it),
- opening: the first word of the span (a small letter counts against it, a word that often opens sentences for it),
- balance: each quotation or bracketed passage of which it holds one end only, so a passage is kept whole unless
  cutting it up is worth more than both its ends: a pair that spans half a text for want of a mark is,
- length: spans without words or of a few letters, and very long ones, lose.

What is lost by a cut in one respect may be gained in another, so no rule alone decides. The search is exact over all
spans of a block and linear: of two possible begins the earlier one can only win where its sum is larger, since its span is longer and
holds no more whole passages, so begins are kept as a falling list of sums, of which there are few.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Words that a full stop shortens and that go on to a name or number (lower case, without the stop).
LEADING = frozenset(
    # titles
    "mr mrs ms dr prof st mt rev gen sgt capt lt col hon dhr mevr mw ir drs hr fr frau herr mme mlle mm vve "
    # references and quantities
    "no nr nrs p pp pg s vol art fig figs sec sect par blz bl hfst ch chap tab eq cf vgl vs resp approx ca env incl excl bzw "
    "inkl zzgl max min ungef circa num pag "
    # examples
    "eg ie zb dh ua bv dwz nl ex "
    # degrees
    "ph "
    # Greek, Devanagari
    "κ κα κος σελ αρ βλ πχ δηλ डॉ श्री प्रो कु सु".split()
)
# Shortened words that may also end a sentence.
EITHER = frozenset("etc usw enz am pm co inc ltd corp jr sr bros dept est jan feb febr mrt apr jun jul aug sep sept okt oct nov dec déc janv févr etal κλπ κτλ".split())
# Words after which a German ordinal number goes on.
AFTER_ORDINAL = frozenset(
    "januar jänner februar märz april mai juni juli august september oktober november dezember quartal jahrhundert jahrestag halbjahr kapitel "
    "klasse stock platz tag woche monat jahr auflage abschnitt etage".split()
)
# Verbs that tie a quotation to its speaker.
SPEECH = re.compile("[问說说道答喊写寫叫]|尋ね|聞い|言っ|言う|答え|書い|述べ|話し|叫ん")
SPEECH_AFTER = re.compile("^(?:と|って|という)")

# Ordinary words that are also shortened ones.
DOUBTFUL = frozenset("no art max min par col tab ex vol num am sec fig hon gen".split())
# Words that often open a sentence (English, Dutch, German, French).
OPENING = frozenset(
    "the this that these those it its he she they we you i there then but and so when if in on at as for after before however nobody all "
    "de het een dit dat deze die hij zij ze wij ik er toen daarna maar en dus als niemand in op na voor "
    "der das ein eine er sie es wir ich dann da aber und wenn nach vor diese dieser dieses niemand alle "
    "le la les un une il elle ils elles nous vous je ce cette ces puis mais et alors si personne après avant".split()
)

OPEN, CLOSE = "“„«「『（([【《〈", "”“»」』）)]】》〉"
STOPS = ".!?…。！？｡।॥‼⁇⁈⁉．"
_CLOSERS = "\"”“»」』）)]】》〉’'"
_CANDIDATE = re.compile(f"[{STOPS};;]+(?:\\s*[{STOPS}]+)*(?:[{_CLOSERS}]|\\s»)*")
_EMPTY_LINE = re.compile(r"(?:\r\n?|\n)[^\S\r\n]*(?:\r\n?|\n)\s*")
_LIST_MARK = re.compile(r"[^\S\r\n]*(?:[-*•‣◦–—·]|\(?\d{1,3}[.)]|\(?[a-zA-Z][)])\s+\S")
_LINE = re.compile(r"\r\n?|\n")
#: Sentences that begin with a small letter: iKV, 't Dorp.
_CAPITAL_LATER = re.compile(r"['’‘]?[^\W\d_](?=[^\W\d_])(?![a-zà-ÿ])|['’‘][a-z]\s+[^\W\d_]")
_THAI = re.compile("[฀-๿]")
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
_CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿]")
_WIDE = {c: c - 0xFEE0 for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), 0xFF0E]}

#: Scores of a boundary that is hardly one, of each end of a passage that a span holds without the other, of a span without a word.
UNLIKELY, HALF, WORDLESS = -12.0, -15.0, -9.0
#: Score of an opening word after a doubtful mark, of a span with fewer letters than a word has, of a small letter that opens.
OPENS, LETTERS_FEW, SMALL = 3.5, -1.0, -0.5
#: Characters of a span below which its letters are counted, and from which each doubling loses LONG.
SHORT, ROOMY, LONG = 8, 400, -0.5

_MARKS = re.compile("[“”„«»「」『』（）()【】《》〈〉\\[\\]\"]")
_BEFORE_WORD = re.compile("[\"“„«‘'(\\[（「『¿¡*\\-–—]*")
_WORD = re.compile(r"[^\W\d_]+")
_NOT_SPACE = re.compile(r"\S")
_CLAUSE = re.compile("[^。！？“「：.!?\n]*")
_OPENED_BY = {"”": "“„", "“": "„", "»": "«", "」": "「", "』": "『", "）": "（", ")": "(", "]": "[", "】": "【", "》": "《", "〉": "〈"}
_WORD_PART = "\xad"


def _passages(text: str, last: bool) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Quotations and bracketed passages ``(begin, end)``, outermost ones in order, and the begin of each by its closing mark.

    Marks are matched innermost first; one without its other mark is stray. In the last block a quotation that stays open goes
    on to the end, as the text may be cut off.
    """
    stack: list[tuple[str, int]] = []
    open_ = dict.fromkeys(OPEN + '"', 0)
    begin_of: dict[int, int] = {}
    for m in _MARKS.finditer(text):
        c, at = m.group(), m.start()
        if c == '"':
            spaced = at and not text[at - 1].isspace() and text[at - 1] not in OPEN
            ends = at + 1 == len(text) or text[at + 1].isspace() or text[at + 1] in CLOSE or text[at + 1] in STOPS + ",;:"
            # by the white space around it where that tells, else by turns
            closes = '"' if open_['"'] and not (not spaced and not ends) else ""
        else:
            closes = _OPENED_BY.get(c, "")
        if any(open_[o] for o in closes):
            while True:
                o, begin = stack.pop()
                open_[o] -= 1
                if o in closes:
                    break
            begin_of[at] = begin
        elif c in OPEN or c == '"':
            stack.append((c, at))
            open_[c] += 1
    pairs = sorted((b, e) for e, b in begin_of.items())
    if last:
        quoted = max((b for b, _ in pairs if text[b] not in "([（【"), default=-1)
        pairs = sorted(pairs + [(at, len(text)) for c, at in stack if c not in "([（【" and at > quoted][:1])
    outer: list[tuple[int, int]] = []
    for b, e in pairs:
        if not outer or b > outer[-1][1]:
            outer.append((b, e))
    return outer, begin_of


class _Block:
    def __init__(self, text: str, last: bool):
        self.text = text
        self.greek = not text.isascii() and bool(_GREEK.search(text))
        self.outer, self.begin_of = _passages(text, last) if _MARKS.search(text) else ([], {})

    def after_closers(self, at: int) -> int:
        """Behind the closing quotations and brackets that follow a stop; marks that also open count where they close one."""
        text = self.text
        while at < len(text):
            c = text[at]
            if c in _CLOSERS and (c not in "“\"'’" or at in self.begin_of):
                at += 1
            elif c.isspace() and text[at + 1 : at + 2] == "»" and at + 1 in self.begin_of:
                at += 2
            else:
                break
        return at

    def opens_a_sentence(self, close: int) -> bool:
        """Whether the quotation that ends at ``close`` stands at the beginning of a sentence."""
        begin = self.begin_of.get(close)
        if begin is None:
            return False
        while begin and self.text[begin - 1].isspace():
            begin -= 1
        return not begin or self.text[begin - 1] in STOPS or self.text[begin - 1] in _CLOSERS

    def last_word(self, at: int) -> tuple[str, str]:
        """The word that ends at ``at``, and it with the shortened words that it is joined to by stops, such as z. B., as far as 12 letters."""
        text, i = self.text, at
        while i and (text[i - 1].isalpha() or text[i - 1] > "\x7f" and (text[i - 1] == _WORD_PART or unicodedata.category(text[i - 1]) in ("Mn", "Mc"))):
            i -= 1
        if i == at:
            while i and text[i - 1].isdigit():
                i -= 1
            return text[i:at].translate(_WIDE), text[i:at].translate(_WIDE)
        begin, j = i, i
        while at - begin <= 12:
            k = begin - 1
            if k >= 0 and text[k].isspace():
                k -= 1
            if k < 0 or text[k] != ".":
                break
            j = k
            while j and text[j - 1].isalpha() and k - j <= 12:
                j -= 1
            if j == k:
                break
            begin = j
        tail, whole = text[i:at], text[begin:at]
        return (tail, whole) if text[begin:at].isascii() else (tail.translate(_WIDE), whole.translate(_WIDE))

    def boundary(self, at: int, stop: str, end: int) -> float:
        """Closing and opening score: how well one span ends and another begins at ``end``, after the mark ``stop`` at ``at``."""
        text = self.text
        if stop == "." and end == at + 1 and text[end : end + 1] == " " and "A" <= text[end + 1 : end + 2] <= "Z":
            # the usual case, with the result of what follows below
            w = text.rfind(" ", at - 24 if at > 24 else 0, at) + 1
            word = text[w:at]
            if w > 1 and len(word) > 1 and word.isalpha() and text[w - 2] != "." and (low := word.lower()) not in LEADING and low not in EITHER:
                return 3.0
        follows = _NOT_SPACE.search(text, end)
        if not follows:
            return 0.0
        nxt_at = follows.start()
        first = text[nxt_at]
        gap = nxt_at > end
        head_at = _BEFORE_WORD.match(text, nxt_at).end()
        nxt = text[head_at] if head_at < len(text) else first
        wide = nxt if nxt < "\x80" else nxt.translate(_WIDE)
        before = text[at - 1] if at else ""
        if before > "\x7f":
            before = before.translate(_WIDE)
        kind, bare = stop[-1], end == at + len(stop)
        if first in ",，、;；:：" or (first in CLOSE and first not in OPEN):
            return UNLIKELY
        if not bare and text[end - 1] in "」』”" and SPEECH_AFTER.match(text[nxt_at : nxt_at + 3]):
            return UNLIKELY
        cjk = wide > "\u2fff" and bool(_CJK.match(wide))
        if not bare and first > "\u2fff" and _CJK.match(first) and self.opens_a_sentence(end - 1):
            if SPEECH.search(text, nxt_at, _CLAUSE.match(text, nxt_at).end()):  # the speaker of the quotation follows
                return UNLIKELY
        if kind > "\x7f" and any(c in "。！？｡।॥" for c in stop):
            return 4.0
        if ";" in stop or "\u037e" in stop:
            return 3.0 if self.greek and gap and before.isalnum() and not wide.islower() else UNLIKELY
        if cjk and kind in "!?":
            return 4.0
        if not gap and bare:
            # a space is missing, or this is no end at all: numbers, initials, names of files
            if stop == "." and not (before.islower() or before.isdigit() or before in ")%"):
                return UNLIKELY
            if not (wide.isupper() or first in OPEN or first == '"' or (wide.isdigit() and text[max(0, at - 2) : at].isalpha())):
                return UNLIKELY
            if wide.isdigit() and before.isdigit():
                return UNLIKELY
        if wide.islower() and not _CAPITAL_LATER.match(text, nxt_at):
            word, _ = self.last_word(at)
            w = word.replace(_WORD_PART, "").lower()
            if not bare or len(stop) > 2 or "…" in stop or (w.isdigit() and (len(w) < 3 or kind == ".") and self.ordinal_follows(nxt_at)):
                return -6.0
            # a text without capitals: only after a word that isn't shortened
            _, chain = self.last_word(at)
            whole = kind in "!?" or len(w) >= 3 and "." not in chain and w not in LEADING and w not in EITHER
            return 1.0 + SMALL if whole and gap else -6.0
        if "!" in stop or "?" in stop or "‼" in stop:
            return 4.0
        if len(stop) > 1 or "…" in stop:  # dots of omission
            return 2.0 if not cjk else -6.0
        if kind != ".":
            return 3.0
        tail, chain = self.last_word(at)
        plain = "".join(c for c in chain if c not in ". " and c != _WORD_PART and not c.isspace()).lower()
        low = tail.replace(_WORD_PART, "").lower()
        if bare:
            if low.isdigit():
                return UNLIKELY if len(low) <= 2 and self.ordinal_follows(nxt_at) else 2.5
            single = len(tail) == 1 and tail.isupper()
            if plain in LEADING or low in LEADING or single:
                # a word of its own, after all, where another sentence opens; never before a number
                if (single and plain == low or low in DOUBTFUL and plain == low) and gap and head_at == nxt_at and not wide.isdigit():
                    word = _WORD.match(text, nxt_at)
                    return -2.0 + (OPENS if word and word.group().lower() in OPENING else 0.0)
                return UNLIKELY
        if plain in EITHER or low in EITHER:
            return 0.5 if wide.isdigit() else 2.0
        if bare and len(tail) == 1 and tail.isalpha():
            return UNLIKELY if "." in chain else -5.0
        if bare and "ऀ" <= nxt <= "ॿ":
            return -5.0
        return 3.0

    def ordinal_follows(self, at: int) -> bool:
        word = _WORD.match(self.text, at)
        return bool(word) and word.group().lower() in AFTER_ORDINAL

    def length(self, begin: int, end: int) -> float:
        """What the length of a span adds; ``begin`` is its first character that is no white space."""
        size = end - begin
        if size <= SHORT:
            letters = sum(map(str.isalpha, self.text[begin:end]))
            return WORDLESS if not letters else LETTERS_FEW if letters < 2 else 0.0
        return LONG * ((size // ROOMY).bit_length()) if size >= ROOMY else 0.0

    def sentences(self) -> list[tuple[int, int]]:
        """The spans of the best segmentation of a block that neither begins nor ends with white space."""
        text, outer = self.text, self.outer
        ends, back = [0], [0]
        # begins of spans still short, and the others by falling sums: [sum of what lies before, first character, number, 1 while one passage has gone on since]
        young, old = [[0.0, 0, 0, 0]], []
        k, low = 0, 0  # the next passage; 1 if the last boundary and this one are in the same
        marks = [(m.start(), m.group(), self.after_closers(m.end())) for m in _CANDIDATE.finditer(text)]
        if not marks or marks[-1][2] < len(text):
            marks.append((len(text), "", len(text)))
        for at, stop, end in marks:
            if end <= ends[-1]:
                continue
            while k < len(outer) and outer[k][1] < end:
                k, low = k + 1, 0
            final = end == len(text)
            inside = int(not final and k < len(outer) and outer[k][0] < end)
            low *= inside
            close = (0.0 if final else self.boundary(at, stop, end)) + HALF * inside
            while young and end - young[0][1] > SHORT:
                e = young.pop(0)
                while old and old[-1][0] <= e[0]:
                    old.pop()
                old.append(e)
            best, of = -math.inf, 0
            for e in (*old, *young):
                e[3] &= low
                size = end - e[1]
                v = e[0] - 2 * HALF * e[3]
                if size <= SHORT or size >= ROOMY:
                    v += self.length(e[1], end)
                if v > best:
                    best, of = v, e[2]
            ends.append(end)
            back.append(of)
            if not final:
                begin = end
                while text[begin].isspace():  # a block ends in no white space
                    begin += 1
                young.append([best + close + HALF * inside, begin, len(ends) - 1, inside])
                low = inside
        out, n = [], len(ends) - 1
        while n > 0:
            out.append((ends[back[n]], ends[n]))
            n = back[n]
        return out[::-1]


def _trim(text: str, begin: int, end: int) -> tuple[int, int]:
    while begin < end and text[begin].isspace():
        begin += 1
    while end > begin and text[end - 1].isspace():
        end -= 1
    return begin, end


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in _EMPTY_LINE.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def split(text: str) -> list[tuple[int, int]]:
    """``(begin, end)`` of each sentence, heading and list line of a text, in code points."""
    out: list[tuple[int, int]] = []
    spans = [s for s in (_trim(text, *b) for b in _blocks(text)) if s[0] < s[1]]
    for k, (begin, end) in enumerate(spans):
        block = text[begin:end]
        lines, at = [], 0
        for m in _LINE.finditer(block):
            lines.append((at, m.start()))
            at = m.end()
        lines.append((at, len(block)))
        found: list[tuple[int, int]] = []
        if all(_LIST_MARK.match(block, a, b) for a, b in lines if block[a:b].strip()) and (len(lines) > 1 or not _sentence_like(block)):
            found = lines
        elif not block.isascii() and _THAI.search(block) and len(_THAI.findall(block)) * 3 > len(block):
            at = 0
            for m in re.finditer(r"\s+", block):
                found.append((at, m.start()))
                at = m.end()
            found.append((at, len(block)))
        else:
            found = _Block(block, k == len(spans) - 1).sentences()
        for a, b in found:
            a, b = _trim(block, a, b)
            if a < b:
                out.append((begin + a, begin + b))
    return out


def _sentence_like(block: str) -> bool:
    """A single line that begins like a list line: a heading or item has no closing mark at its end."""
    return block.rstrip().rstrip(_CLOSERS)[-1:] in STOPS


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "sent_start", "sent_end", "sentence"]
    for batch in batches:
        ids, rows, begins, ends, texts, size = batch.column(0), [], [], [], [], 0
        for k, text in enumerate(batch.column(1)):
            t = text.as_py()
            if not t:
                continue
            for b, e in split(t):
                rows.append(k)
                begins.append(b)
                ends.append(e)
                texts.append(t[b:e])
            size += len(t)
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(texts, pa.string())], names)
                rows, begins, ends, texts, size = [], [], [], [], 0
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(texts, pa.string())], names)


def sentences(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, sent_start, sent_end, sentence)``: the units of every text; offsets in code points, end exclusive.

    Null, empty and blank texts have none. Each row is split by itself, so repeated rows give repeated units; a
    row without an id is split too. No shuffle; a text of any length takes time in proportion to it.
    """
    rows = documents.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_split_batches, "id long, sent_start int, sent_end int, sentence string").withColumnRenamed("id", "doc_id")
