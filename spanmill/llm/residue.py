"""Template residue, filler and error pages standing in for content (problem 9).

Texts are cut into units (sentences outside code, places of a template masked
as one sign). Few strict rules label units that can be nothing else as trusted
residue. Labels then spread over near duplicates: each unit has a SimHash that
is partitioned into blocks, each block voted on by its own share of the words,
so that a change of few words leaves other blocks as they were. Tables are
keyed by blocks; pairs that meet in a table are verified by the Hamming
distance of their whole SimHashes, then by the similarity of their texts. What
is labelled in the end is the connected components that hold a trusted unit.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, is_empty
from .text import _INVISIBLE

#: Near duplicates: similarity (Jaccard) of the texts' 4-grams.
MIN_SIMILARITY = 0.8
#: A SimHash has so many blocks of so many bits.
BLOCKS, BLOCK_BITS = 6, 32
#: Bits in which the SimHashes of near duplicates differ at most (of 192; see README for what is lost by it).
MAX_DISTANCE = 56
#: A table is keyed by one block, or by two, with so many words or more (a third of the unit's, if that is fewer).
KEY_WORDS = 3
#: Longs of the bit map of the front's table keys: the size of what is broadcast, whatever the corpus.
BITMAP_ROWS = 1 << 17

ANYWHERE, ALONE = 2, 1

# ------------------------------------------------------------------- cutting
_CODE = re.compile(r"(?ms)^[ \t>]*(```|~~~).*?(?:^[ \t>]*\1[ \t]*$|\Z)|<pre\b.*?(?:</pre>|\Z)|<code\b.*?(?:</code>|\Z)|`[^`\n]+`")
# Only real markup: <topic here> and the like are placeholders and stay.
_MARKUP = re.compile(
    r"</?(?:a|abbr|b|blockquote|body|br|center|div|em|font|h[1-6]|head|hr|html|i|img|li|main|meta|ol|p|section|small|span|strong|sub|sup|table|tbody|td|th|title|tr|u|ul)(?:\s[^<>]*)?/?>", re.I
)
_BREAK = re.compile(r"</?(?:br|hr|p|div|h[1-6]|li|tr|ul|ol|table|blockquote|title|body|head|section)(?:\s[^<>]*)?/?>", re.I)
_STAMP = re.compile(r"\s*[\[(](?:[0-9a-f]{4,}|ref[.:]? ?\w+)[\])]\s*$", re.I)
_BEFORE = " \t\r\f\v >|*#=~-–—•·"
_AFTER = " \t\r\f\v |*#=~-–—•·"
#: Where a sentence ends.
_STOP = re.compile(r"(?<=[.!?…])\s+(?=\S)")
_DIGITS = re.compile(r"\d+")
#: Hexadecimal runs after numbers became 0; one with both kinds of digits is an id.
_HEX = re.compile(r"(?<![a-z0])[a-f0]{3,}(?![a-z0])")
#: A sentence before a notice that only reports it.
_REPORTS = re.compile(r":\s*$|(?<!\w)(?:says?|said|saying|shows?|showed|prints?|printed|displays?|returns?|reads?|gets?|got|see|saw|messages?|errors?|warnings?|called|titled)(?!\w)", re.I)
_QUOTES = re.compile("[\"“”„«»]")

# -------------------------------------------------------------- places of templates
SLOT = "§"
_NAME = r"[A-Za-z_][\w .\-]{0,40}"
_MAYBE = re.compile(r"[{}\[\]<%$#@_]|undefined|NaN|null|None|X{3}")
#: Trusted: delimiters that nobody writes in prose. One rule each.
SLOT_RULES = [
    rf"\{{\{{\s*{_NAME}\s*\}}\}}",
    rf"\{{%\s*{_NAME}\s*%\}}",
    rf"<%=?\s*{_NAME}\s*%>",
    rf"[$#]\{{\s*{_NAME}\s*\}}",
    rf"\$\(\s*{_NAME}\s*\)",
    rf"\[\[\s*{_NAME}\s*\]\]",
    rf"@@\s*{_NAME}\s*@@",
    rf"%%\s*{_NAME}\s*%%",
    r"(?<![\w%])%[A-Z][A-Z_]{2,}%(?![\w%])",
    r"(?<!\w)__[A-Z][A-Z_ ]*__(?!\w)",
    r"\[(?!(?:EDIT|SOLVED|UPDATED?|CLOSED|NOTE|DUPLICATE|RESOLVED|FIXED|OFF TOPIC)\])[A-Z]{4,}(?:[ _][A-Z]+)*\](?!\()",
    r"<(?:your|insert|enter) [a-z ]+>|<[a-z][a-z ]* here>",
]
#: Not trusted by themselves: what programs print where they had no value, and delimiters that also occur elsewhere.
_WEAK_SLOT = r"\[object Object\]|(?<![\w.%])%[sd](?!\w)|(?<!\w)(?:undefined|NaN|null|None|X{3,})(?!\w)|(?<![\w$#{])\{(?:\d|[a-z_][a-z_. ]*)\}(?!\})|<[a-z][a-z ]{2,30}>"
_CODEISH = re.compile(r"```|~~~|[;={}]|=>|\breturn\b|\bconst\b|\blet\b|\bdef\b|\bprint\(|\braise\b|^\s*(?:if|for|while|try|except)\b")
_QUOTED_OR_OWN = re.compile(r"[\"“”?]|(?<!\w)(?:I|my)(?!\w)")

# ------------------------------------------- notices: whole sentences, lower case, numbers as 0
_JS = r"(?:java ?scripts?|js|scripts?|scripting)"
_THING = r"(?:page|url|address|thread|post|file|resource|document|question|answer|content|site|item)"
#: What may stand in any company. One rule each.
ANYWHERE_RULES = [
    rf"(?:please |you (?:need|have) to |you must |to (?:view|use|continue)[^.]*?, (?:please )?)?(?:enable|activate|turn on|switch on|allow) {_JS}\b[^?]*",
    rf"{_JS} (?:must|has to|have to|needs? to|should) be (?:enabled|allowed|activated|turned on|switched on)\b[^?]*",
    rf"{_JS} (?:is|are|seems to be|appears to be) (?:disabled|required|turned off|switched off|blocked|not enabled)\b[^?]*",
    rf"(?:your|this) browser (?:does not|doesn'?t) support {_JS}\b[^?]*",
    rf"(?:this|our|the) (?:site|page|app|application|forum|thread) (?:needs|requires|relies on|works only with) {_JS}\b[^?]*",
    rf"if nothing happens, (?:please )?(?:switch|turn) on {_JS}.*|no ?script: .*",
    rf"(?:bitte (?:aktivieren|schalten) sie|(?:veuillez )?activer?z?|(?:por favor )?(?:active|activa|habilite|habilita|ative|ativa)) (?:el |o |le )?{_JS}\b[^?]*",
    rf"(?:(?:sorry|oops)[,!.]* )?the (?:requested )?{_THING} (?:(?:that )?you (?:asked|were looking|are looking|requested)[^.?]*? )?(?:does not exist|could not be found|was not found|cannot be found|no longer exists|has been)\b[^?]*",
    rf"this {_THING} (?:has been|was) (?:removed|deleted)\b[^?]*",
    r"(?:oops|whoops|uh-oh|we'?(?:re| are) sorry|sorry)[!,.]+(?: but)? (?:something went wrong|an error (?:has )?occurr?ed)\b[^?]*|something went wrong(?: on our (?:side|end))?[.!]?|an (?:unexpected|internal) error (?:has )?occurr?ed[.!]?",
    r"(?:please )?(?:try again|come back) (?:later|in (?:a few|0) (?:minutes|moments|seconds|hours))[.!]?|retry after 0+ seconds[.!]?",
    r"(?:the|this|our) (?:service|site|server|page|website) is (?:temporarily |currently )?(?:unavailable|down|under (?:construction|maintenance)|closed)\b[^?]{0,60}|(?:we are|site is) (?:down|closed) for (?:scheduled )?maintenance[^?]*",
    r"(?:error establishing a|unable to connect to the|could not connect to the|cannot connect to the) (?:database|server)(?: connection| server)?[.!]?|(?:database|server|proxy) connection (?:failed|refused|timed out|lost)\b[^?]*",
    r"(?:your )?session (?:has )?(?:expired|timed out)[.!]?|ihre sitzung ist abgelaufen[.!]?|su sesión ha (?:caducado|expirado)[.!]?|votre session a expiré[.!]?|a sua sessão expirou[.!]?",
    r"(?:please )?(?:sign|log) in again to continue[.!]?|bitte melden sie sich erneut an[.!]?",
    r"checking your (?:connection|browser) before (?:you proceed|accessing).*",
    r"(?:please )?(?:verify|confirm|prove) (?:that )?you are (?:a )?human\b.*",
    r"(?:access denied[.!]? )?you do not have permission to (?:view|access|see) this [\w ]{1,20}[.!]?|you have been (?:rate limited|blocked|banned)[.!]?",
    r"we value your privacy[.!]?|accept (?:all )?cookies\b.*",
]
#: What counts where nothing else stands in its line but notices. One rule each.
ALONE_RULES = [
    r"(?:(?:error|http|status) )*0+\W{0,5}(?:(?:page|file) )?(?:not found|bad gateway|forbidden|unauthorized|gone|gateway time-?out|bad request|(?:internal )?server error|service (?:temporarily )?unavailable)[.!]?(?: (?:nginx|apache|[a-z]+proxy)/0.*| reference: \S+)?",
    r"(?:error|fehler|erreur|erro) 0+\W{0,4}(?:page not found|internal server error|seite nicht gefunden|página no encontrada|página não encontrada|page introuvable)[.!]?(?: reference: \S+)?",
    r"(?:internal server error|interner serverfehler|error interno del servidor|erreur interne du serveur|erro interno do servidor|bad gateway|page not found|too many requests|access (?:is )?denied|page under construction)\W{0,3}(?:0\W{0,2})?",
    r"(?:[\w ]+ )?(?:fatal|parse|uncaught|syntax) error: .* in /\S+(?: on line 0|:0)[.]?",
    r"traceback \(most recent call last\):.*",
    r"loading [\w ]{1,30}(?:…|\.\.\.)",
    r'\{ ?"?(?:error|status|message)"? ?: ?\{?.*\}',
    r"<!-- ?(?:remove this|describe|add|insert|enter|please|write|put|replace|your)\b.*-->",
    r"\[(?:describe|add|insert|enter|type|write|put|paste|fill in|explain|your)\b[^\]]{2,80}\]\W?|\((?:describe|add|insert|enter|type|write|put|paste|fill in)\b[^)]{2,80}\)\W?",
    r"(?:your|the) [\w ]{2,40} goes here[.!]?|(?:insert|enter|type|write|add|put|paste) (?:your|the|a) [\w ]{2,40} here[.!]?",
    r"(?:todo|tbd|fixme)\b ?[:\-] ?(?:write|add|insert|fill|complete|describe|answer|content|text)\b(?: [\w']+){0,4}[.!]?|(?:text|content|description|answer) (?:to follow|coming soon|goes here)[.!]?",
]
#: Every notice holds one of these or begins with a sign: a quick look before the rules.
_TRIGGERS = (
    "script js exist found removed deleted moved wrong occur again retry unavailable down closed construction maintenance establishing connect session sitzung sesión sessão human permission cookies privacy gateway "
    "forbidden unauthorized gone error fehler erreur erro gefunden introuvable requests denied traceback loading here todo tbd fixme to-follow coming-soon have-been bad-request come-back erneut no-longer has-been"
).split()


def _automaton(words: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w.replace("-", " "), True)
    a.make_automaton()
    return a


_TRIGGER = _automaton(_TRIGGERS)


def may_be_notice(m: str) -> bool:
    return next(_TRIGGER.iter(m), None) is not None or m[0] in "{<[("


#: What may stand beside a notice: navigation, rights, a server's name, a number.
_ASIDE = re.compile(r"home(?: \| \w+)+|(?:©|\(c\)|copyright)? ?(?:0+ )?all rights reserved\.?|[\w-]+/0+(?:\.0+)*|back to home\.?|(?:http |error )*0+[.:]?|that'?s an error[.!]?|(?:reference:|incident) \S+", re.I)
#: Signs of somebody talking about a message: quotation, a question, the first person.
_TALK = re.compile(r"[\"“”„«»?]|(?<!\w)(?:i|i'm|my|our|mine|how do|why|where|what is|anyone)(?!\w)", re.I)

# ------------------------------------------------------------------- filler
#: A line that begins so is filler however long it is.
_LOREM = re.compile(r"lorem ipsum (?!for\b|in\b|as\b|is\b|text\b|generator\b|was\b|to\b)[^?]*$", re.S)
#: The syllables of pseudo-Latin filler.
_LATIN = re.compile(
    r"(?:adip|amet|cing|con|dio|dolor|do|eius|elit|em|et|ex|fe|inci|ip|isi|labor|la|lis|lor|lo|ma|mod|na|nul|pha|qui|quis|rem|re|sec|sed|sit|sque|sum|tem|te|tetur|tra|tur|ur|uris|ut|vel|am|ali|qua|eni|minim|nostrud)+"
)
#: Words of a stretch in which filler is looked for.
_STRETCH = 24
_FORM_LABEL = re.compile(r"(?im)^[ \t]*(?:steps to reproduce|expected (?:result|behaviou?r)|actual (?:result|behaviou?r)|environment|version|description)[ \t]*:[ \t]*$")
FILLER_RULES = ["lorem ipsum", "one or few words over and over", "pseudo-Latin", "empty form"]

#: Numbers of all rules, for tests that hold some out.
RULES = [f"slot {i}" for i in range(len(SLOT_RULES))] + [f"anywhere {i}" for i in range(len(ANYWHERE_RULES))] + [f"alone {i}" for i in range(len(ALONE_RULES))] + [f"filler {i}" for i in range(len(FILLER_RULES))]


class Rules:
    """The rules without those held out."""

    def __init__(self, held_out: frozenset[str] = frozenset()):
        keep = lambda kind, rules: [r for i, r in enumerate(rules) if f"{kind} {i}" not in held_out] or [r"(?!)"]
        self.slot = re.compile("|".join(keep("slot", SLOT_RULES)))
        self.any_slot = re.compile("|".join([*SLOT_RULES, _WEAK_SLOT]))
        self.anywhere = re.compile("|".join(keep("anywhere", ANYWHERE_RULES)), re.S)
        self.alone = re.compile("|".join(keep("alone", ALONE_RULES)), re.S)
        self.filler = [f"filler {i}" not in held_out for i in range(len(FILLER_RULES))]

    def is_filler(self, m: str) -> bool:
        """One or few words over and over, or pseudo-Latin from end to end.

        A text of many words is looked at stretch by stretch: nine in ten must be so.
        """
        if self.filler[0] and _LOREM.match(m):
            return True
        w = m.split()
        if len(w) < 4:
            return False
        latin = self.filler[2] and (_LATIN.fullmatch(w[0]) or _LATIN.fullmatch(w[1]))
        if not latin and len(w) <= _STRETCH and len(set(w)) > 0.8 * len(w):
            return False
        if self.filler[1] and self._repeats(w):
            return True
        if not latin:
            return False
        w = self._bare(w)
        if len(w) < 6 or w[0] in ("where", "how") or sum(bool(_LATIN.fullmatch(x)) for x in w[:6]) < 5:
            return False
        return sum(bool(_LATIN.fullmatch(x)) for x in w) >= 0.9 * len(w)

    @staticmethod
    def _bare(words: list[str]) -> list[str]:
        return [x for x in (x.strip(".,;:!-") for x in words) if x[:1].isalpha()]

    def _repeats(self, w: list[str]) -> bool:
        starts = range(0, max(1, len(w) - _STRETCH // 2), _STRETCH)
        other = 0
        for i in starts:
            p = w[i : i + _STRETCH]
            few = len(set(p)) <= 0.8 * len(p)
            if few:
                p = self._bare(p)
                few = len(p) >= 4 and ((kinds := len(set(p))) * 4 <= len(p) or kinds == 1)
            other += not few
            if other > 0.1 * len(starts):
                return False
        return True

    def notice(self, m: str) -> int:
        """How far a sentence is trusted as a notice: ANYWHERE, ALONE or 0."""
        found = ANYWHERE if self.anywhere.fullmatch(m) else ALONE if self.alone.fullmatch(m) else 0
        if found and _TALK.search(m) and not (m[0] in "{[(<" or m.startswith(("fatal error", "traceback", "oops"))):
            return 0
        return found


def without_code(text: str) -> str:
    if "`" not in text and "~~~" not in text and "<pre" not in text and "<code" not in text:
        return text
    return _CODE.sub(lambda m: " `` " if m.group(0)[0] == "`" and m.group(1) is None else "\n", text)


def unit_lines(text: str) -> list[str]:
    """Lines outside code, without markup, compatibility forms folded; empty ones part paragraphs."""
    t = without_code(text)
    if "<" in t:
        t = without_code(_BREAK.sub("\n", t))
    if "&" in t:
        t = without_code(html.unescape(t))
    if "<" in t:
        t = _MARKUP.sub("", t)
    if not t.isascii():
        t = unicodedata.normalize("NFKC", _INVISIBLE.sub("", t)) if "…" not in t else _INVISIBLE.sub("", t)
    return [line.lstrip(_BEFORE).rstrip(_AFTER) for line in t.split("\n")]


def masked(line: str) -> str:
    """Lower case, numbers as 0, ids and a stamp at the end taken off."""
    t = (_STAMP.sub("", line) if line[-1] in "])" else line).lower()
    d = _DIGITS.sub("0", t)
    if d is not t and d != t:
        t = _HEX.sub(lambda m: "0" if "0" in m.group(0) else m.group(0), d)
    return " ".join(t.split())


def empty_form(text: str) -> bool:
    """Two labels of a form with nothing filled in between."""
    if ":" not in text:
        return False
    t = without_code(text)
    labels = list(_FORM_LABEL.finditer(t))
    for a, b in zip(labels, labels[1:]):
        if not re.sub(r"(?m)^[ \t]*(?:\d+[.)]|[-*])[ \t]*$", "", t[a.end() : b.start()]).strip():
            return True
    return False


def _of_line(line: str, rules: Rules, out: dict[tuple[str, bool], int]) -> None:
    """Puts the units of a line into `out`: (masked sentence, stands alone) -> how far it is trusted."""
    m = masked(line)
    if not m:
        return
    if rules.is_filler(m):
        out[m, True] = ANYWHERE
        return
    slotted, maybe = _MAYBE.search(line), may_be_notice(m)
    if not slotted and not maybe:
        parts = _STOP.split(m)
        for part in parts:
            out.setdefault((part, len(parts) == 1), 0)
        return
    parts = _STOP.split(line if slotted else m)
    found, quoted, before, quoting = [], 0, "", _QUOTES.search(line)
    for part in parts:
        slots, shown = False, part
        if slotted:
            shown = rules.any_slot.sub(SLOT, part)
            if shown != part and rules.slot.search(part):
                rest = rules.slot.sub(" ", part)
                slots = not _CODEISH.search(rest) and not _QUOTED_OR_OWN.search(rest)
            m = masked(shown)
        else:
            m = part
        if m:
            may = maybe and may_be_notice(m)
            trust = ANYWHERE if slots else may and (rules.notice(m) or (shown != part and rules.notice(masked(part))))
            # what is quoted or reported is neither a seed nor a hit, unless its slots are open
            told = may and not slots and (quoted % 2 == 1 or bool(before and _REPORTS.search(before)))
            found.append((m, 0 if told else int(trust), told))
            # a notice or its number reports nothing
            before = "" if trust or may and _ASIDE.fullmatch(m) else part
        if quoting:
            quoted += len(_QUOTES.findall(part))
    alone = all(trust or _ASIDE.fullmatch(m) for m, trust, _ in found) or len(found) == 1
    for m, trust, told in found:
        if not told:
            key = m, alone
            trust = trust if alone or trust == ANYWHERE else 0
            out[key] = max(out.get(key, 0), trust)


def units(text: str, rules: Rules | None = None) -> dict[tuple[str, bool], int]:
    """(masked unit, stands alone in its line) -> ANYWHERE or ALONE if trusted residue, else 0.

    Lines of a paragraph that end without a stop are also read as one, so a
    sentence that is broken over lines is a unit too; where the next line
    begins with a capital, which may be a heading or a list, only if trusted.
    """
    rules = rules or _ALL
    out: dict[tuple[str, bool], int] = {}
    joined: list[str] = []
    lower = True

    def read_as_one() -> None:
        if len(joined) > 1:
            more = out if lower else {}
            _of_line(" ".join(joined), rules, more)
            if not lower:
                out.update({k: v for k, v in more.items() if v > out.get(k, 0)})

    for line in unit_lines(text):
        if line:
            _of_line(line, rules, out)
            if joined and joined[-1][-1] not in ".!?…:":
                lower = lower and line[0].islower()
                joined.append(line)
                continue
        read_as_one()
        joined, lower = [line] if line else [], True
    read_as_one()
    if rules.filler[3] and empty_form(text):
        out["(empty form)", True] = ANYWHERE
    return out


_ALL = Rules()


def _cut(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc, unit, alone, trust = [], [], [], []
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if t:
                found = units(t, rules)
                doc += [d] * len(found)
                unit += [u for u, _ in found]
                alone += [a for _, a in found]
                trust += found.values()
        cols = [pa.array(doc, pa.int64()), pa.array(unit, pa.string()), pa.array(alone, pa.bool_()), pa.array(trust, pa.int8())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "unit", "alone", "trust"])


# ------------------------------------------------------------------ SimHashes
#: Signs of scripts without spaces are words by themselves.
_IDEOGRAPHS = r"([\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}])"
#: What is no part of a word at its ends.
_PUNCTUATION = ".,;:!?()[]{}<>/|\"'`*_~#=+-…“”„«»–—"


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(number of each word's text, of each word, the words)."""
    texts = texts.fill_null("")
    if pc.any(pc.match_substring_regex(texts, _IDEOGRAPHS)).as_py():
        texts = pc.replace_substring_regex(texts, _IDEOGRAPHS, r" \1 ")
    lists = pc.utf8_split_whitespace(texts)
    text, flat = pc.list_parent_indices(lists), pc.utf8_trim(pc.list_flatten(lists), _PUNCTUATION)
    some = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(some).dictionary_encode()
    return text.filter(some).to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def _ballots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(block, votes for its bits) of words: the sum of +-1 over the bits of their 4-grams' hashes."""
    block = np.empty(len(words), dtype=np.int64)
    hashes, n = [], np.empty(len(words), dtype=np.int64)
    for i, w in enumerate(words):
        block[i] = xxhash.xxh3_64_intdigest(w, 1) % BLOCKS
        p = f" {w} "
        n[i] = max(1, len(p) - 3)
        hashes += [xxhash.xxh32_intdigest(p[k : k + 4]) for k in range(n[i])]
    bits = np.unpackbits(np.array(hashes, dtype=np.uint32).view(np.uint8).reshape(-1, 4), axis=1).astype(np.int16)
    votes = np.add.reduceat(2 * bits - 1, np.cumsum(n) - n, axis=0) if len(words) else np.zeros((0, BLOCK_BITS), dtype=np.int16)
    return block, votes


def simhashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(SimHashes as one uint32 per text and block, words per text and block).

    A block without words is 0.
    """
    words = np.zeros((len(texts), BLOCKS), dtype=np.int64)
    out = np.zeros((len(texts), BLOCKS), dtype=np.uint32)
    text, ids, vocab = _words(texts)
    if not len(ids):
        return out, words
    block, votes = _ballots(vocab)
    cell = text * BLOCKS + block[ids]
    order = np.argsort(cell, kind="stable")
    cell, ids = cell[order], ids[order]
    at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    words.ravel()[cell[at]] = np.diff(np.append(at, len(cell)))
    # few words at a time: the votes of all are not held at once
    step = 1 << 16
    ends = np.append(at, len(cell))
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + step, side="right")) - 1)
        sums = np.add.reduceat(votes[ids[ends[lo] : ends[hi]]], at[lo:hi] - ends[lo], axis=0, dtype=np.int32)
        out.ravel()[cell[at[lo:hi]]] = np.packbits(sums > 0, axis=1).view(np.uint32).ravel()
        lo = hi
    return out, words


_PAIRS = [(i, j) for i in range(BLOCKS) for j in range(i + 1, BLOCKS)]


def table_keys(sims: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """Keys of each unit in the tables: its blocks with enough words, and pairs of the others.

    Enough are KEY_WORDS, or a third of the unit's words if that is fewer. One
    changed word touches two blocks at most, so units of many words that differ
    in few share a key. A text's words need not be in order for this; the text
    check sees to that.
    """
    enough = np.clip(words.sum(axis=1) // 3, 1, KEY_WORDS)
    with np.errstate(over="ignore"):
        mix = lambda h: (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        wide = sims.astype(np.uint64)
        cols, used = [], []
        for i in range(BLOCKS):
            cols.append(mix(mix(wide[:, i] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1))))
            used.append(words[:, i] >= enough)
        single = list(used)
        for i, j in _PAIRS:
            both = mix(wide[:, i] | (wide[:, j] << np.uint64(32)))
            cols.append(mix(both * np.uint64(0x9E3779B97F4A7C15) + np.uint64(100 + i * BLOCKS + j)))
            used.append((words[:, i] > 0) & (words[:, j] > 0) & (words[:, i] + words[:, j] >= enough) & ~single[i] & ~single[j])
    keys, mask = np.stack(cols, axis=1).view(np.int64), np.stack(used, axis=1)
    return [k[m] for k, m in zip(keys, mask)]


_SIMS = [f"s{k}" for k in range(BLOCKS // 2)]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows == 0:
            continue
        sims, words = simhashes(b.column(1))
        keys = table_keys(sims, words)
        ends = np.cumsum([0, *map(len, keys)])
        longs = np.ascontiguousarray(sims).view(np.int64)
        cols = [*b.columns, *[pa.array(longs[:, k]) for k in range(longs.shape[1])], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))]
        yield pa.RecordBatch.from_arrays(cols, names=["h", "unit", "trust", *_SIMS, "keys"])


def grams(text: str) -> set[str]:
    return {text[i : i + 4] for i in range(max(1, len(text) - 3))}


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            p, q = grams(x), grams(y)
            keep.append(len(p & q) >= least * len(p | q) - 1e-9)
        t = pa.Table.from_batches([b]).select(["h", "t0"]).filter(pa.array(keep, pa.bool_()))
        yield from t.combine_chunks().to_batches()


def _bitmap(front: DataFrame) -> DataFrame:
    """Which table keys the front has, as bits: BITMAP_ROWS rows at most."""
    return front.groupBy(_slot().alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(key & 63 as int)))").alias("bits"))


def _slot():
    return F.expr(f"shiftrightunsigned(key, 6) & {BITMAP_ROWS - 1}")


def cut_units(docs: DataFrame, doc_id: str, text: str, rules: Rules) -> DataFrame:
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda it: _cut(it, rules), "doc_id bigint, unit string, alone boolean, trust tinyint").withColumn("h", F.xxhash64("unit"))


def find_residue(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = MIN_SIMILARITY, max_distance: int = MAX_DISTANCE, held_out: frozenset[str] = frozenset()
) -> DataFrame:
    """(doc_id, n_units, n_spread): documents with residue, how many of its
    units are, and how many of these no rule knew.

    `held_out` names rules (see RULES) to leave out. Null and empty texts have
    no units; repeated rows count once; rows with a null id are left out; an
    empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "residue")
    cut = scratch.put(cut_units(docs, doc_id, text, Rules(held_out)))
    distinct = cut.groupBy("h", "unit").agg(F.max("trust").alias("trust")).select("h", "unit", "trust")
    known = scratch.put(distinct.mapInArrow(_hashed, "h bigint, unit string, trust tinyint, " + ", ".join(f"{s} bigint" for s in _SIMS) + ", keys array<bigint>"))
    newest = known.where("trust > 0").select("h", "unit", F.col("trust").alias("t"), *_SIMS, "keys")
    labels = newest.select("h", "t")
    gains = None
    apart = " + ".join(f"bit_count({s} ^ {s}0)" for s in _SIMS)
    while True:
        front = newest.select(F.col("h").alias("h0"), F.col("unit").alias("unit0"), F.col("t").alias("t0"), *[F.col(s).alias(f"{s}0") for s in _SIMS], F.explode("keys").alias("key"))
        near = known.where(F.col("trust") < 2).select("h", "unit", "trust", *_SIMS, F.explode("keys").alias("key"))
        # Rows that can meet the front are picked out before any exchange. The
        # bit map has BITMAP_ROWS rows at most; a full one lets all rows pass.
        bits = F.broadcast(_bitmap(front))
        near = near.withColumn("slot", _slot()).join(bits, "slot").where("(shiftrightunsigned(bits, cast(key & 63 as int)) & 1) = 1").drop("slot", "bits")
        pairs = near.join(front, "key").where(f"h <> h0 and trust < t0 and {apart} <= {max_distance}")
        pairs = pairs.groupBy("h", "h0").agg(F.first("unit").alias("unit"), F.first("unit0").alias("unit0"), F.first("t0").alias("t0")).select("h", "unit", "unit0", "t0")
        if gains is not None:
            old = gains.select(F.col("h").alias("hg"), F.col("t").alias("tg"))
            pairs = pairs.join(old, F.col("h") == F.col("hg"), "left").where("tg is null or tg < t0").select("h", "unit", "unit0", "t0")
        gained = scratch.put(pairs.mapInArrow(lambda it: _alike(it, similarity), "h bigint, t0 tinyint").groupBy("h").agg(F.max("t0").alias("t")))
        if is_empty(gained):
            break
        newest = known.join(gained, "h").select("h", "unit", "t", *_SIMS, "keys")
        gains = gained if gains is None else scratch.put(gains.unionByName(gained).groupBy("h").agg(F.max("t").alias("t")))
    if gains is not None:
        labels = labels.unionByName(gains).groupBy("h").agg(F.max("t").alias("t"))
    spread = cut.join(labels, "h").where("alone or t = 2 or trust > 0").select("doc_id", "h", "trust")
    return spread.groupBy("doc_id", "h").agg(F.max("trust").alias("trust")).groupBy("doc_id").agg(F.count("*").alias("n_units"), F.count(F.when(F.col("trust") == 0, 1)).alias("n_spread"))


def without_residue(docs: DataFrame, residue: DataFrame) -> DataFrame:
    """The corpus without the documents found."""
    return docs.join(residue.select("doc_id"), "doc_id", "left_anti")
