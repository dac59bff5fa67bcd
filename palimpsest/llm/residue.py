"""Template residue: unfilled slots, filler, error pages and script notices.

One automaton matches all phrases at once.  What it matches is then weighed against
the text around it: a page counts when matches cover most of the document or of its
rest from some line on, filler when it covers most of a paragraph, comment or value,
and a slot when it stands where the author's own words should be.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm import phrases

#: Part of the letters of a document's rest, or of a paragraph, that matches must cover.
COVERAGE = 0.7
#: The same where the match is the whole document, which then has no line of the author's, and should be no prose.
WHOLE_COVERAGE = 0.5
#: And of all its letters, those of words that say nothing by themselves among them.
MATCHED = 0.12
#: Filler words a paragraph must have at least, and sentences of filler.
FILLER_WORDS, FILLER_SENTENCES = 5, 1

TEMPLATE_FOLDERS = frozenset(("template", "templates", "scaffold", "scaffolds", "scaffolding", "skeleton", "skeletons", "boilerplate", "cookiecutter", "archetype", "generators"))
TEMPLATE_ENDINGS = (".tmpl", ".tpl", ".template", ".j2", ".jinja", ".jinja2", ".erb", ".mustache", ".hbs", ".handlebars", ".ejs", ".in", ".liquid", ".twig", ".dist", ".sample", ".cookiecutter")
_CODE = frozenset(("py", "pyi", "js", "mjs", "cjs", "jsx", "ts", "tsx", "go", "java", "rs", "c", "h", "cc", "cpp", "hpp", "css", "scss", "sql", "sh", "bash", "kt", "rb", "php", "swift", "scala"))

_PROSE = frozenset(("md", "markdown", "rst", "txt", "adoc", "tex", "org"))
_HASH = frozenset(("py", "pyi", "sh", "bash", "rb", "php"))
_DASH = frozenset(("sql",))
_TRIPLE = frozenset(("py", "pyi", "kt", "java", "scala", "swift"))
_TICK = frozenset(("js", "mjs", "cjs", "jsx", "ts", "tsx", "go"))

SLOT, PAGE, NOTICE, FILLER = "slot", "page", "notice", "filler"

#: Of pages, what is no word: addresses, times, numbers, names of servers with versions, traces of a stack.
_WRAPPING = re.compile(
    r"https?://\S+|\bat [\w.$<>]+\([^()\n]*\)|\b(?:java|javax|org|com)\.[\w.$]+|\b[a-z][\w.-]*/\d+(?:\.\d+)*|\b(?=[\w-]*\d)[\w-]{4,}\b|\b\S*[+/=]\S{12,}|\b(?:[a-z0-9-]+\.)+(?:com|org|net|io|dev|edu|gov|example|local|invalid|test)\b"
    r"|\b(?:mon|tue|wed|thu|fri|sat|sun|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b|\b(?:gmt|utc|am|pm)\b|\b(?:get|head|post|put) /\S*"
    # Without blanks between words: what such notices say around their phrases.
    r"|このページ|このサイト|このファイル|お使いの|お探しの|ブラウザ|ページ|ファイル|表示するには|利用するには|続行するには|にしてください|してください|ください|設定|请求的|您的|请在|请|浏览器|中|以继续|以查看|查看|此页面|页面|文件|您|的|이 페이지를|이 사이트를|브라우저에서|브라우저|페이지|파일|보려면|사용하려면|계속하려면|하세요|하십시오|해주세요"
)
_ELEMENTS = re.compile(r"<(script|style|title)\b[^>]*>.*?</\1\s*>", re.S)
_TAG = re.compile(r"</?[a-z!?][^<>\n]*>")
_FENCE = re.compile(r"^[ \t]*(```|~~~).*?^[ \t]*\1[^\n]*$|`[^`\n]+`", re.S | re.M)
_COMMENT = re.compile(r"^\s*(?:#(?!!)|//+|/\*+|\*(?!/)|--|;|<!--)\s?(.*?)(?:\s*(?:\*/|-->))?$")
#: Between paragraphs of a comment: a line of nothing but its signs.
_COMMENT_BREAK = re.compile(r"\n[ \t\r]*(?:#+|//+|\*|--|;)?[ \t\r]*(?=\n)")
_COMMENT_SIGNS = re.compile(r"^[ \t]*(?:#+|//+|/\*+|\*(?!/)|--|;)?[ \t]?|[ \t]*(?:\*+/)?[ \t\r]*$", re.M)
#: What a value that stands alone has before it, its name, and behind it.
_NAMED, _ENDS = re.compile(r"[\w\])\"'][ \t]*(?::?=|:)[ \t]*$"), re.compile(r"[ \t]*(?:[,;})\]\r\n]|#|//|--|$)")
#: Where filler is made, tested or listed.
_MAKER = re.compile(r"\b(?:rand\w*|shuffle\w*|sample|choices?|split|expect)[ \t]*\(|\bfaker\b|\bassert")
_TEST_PATH = re.compile(r"(?:^|[/._-])(?:tests?|specs?|fixtures?|mocks?|messages?|locales?|i18n|faker|lorem)(?:[/._-]|$)")
_MASH = re.compile(r"(?:\b[asdfghjkl]{2,9}\b[ .,\n]+){7,}")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_UNITS = re.compile(r'\n[ \t\r]*\n|</?(?:p|h\d|li|td|th|div|section|br|footer|header|body|html|head|title|ul|ol|tr|table|blockquote|main|article|span|a)\b[^>]*>|"\s*:\s*"|",?\s*\n|:\s+"')


@lru_cache(1)
def automaton():
    """All phrases, lower-case, with their kind and length."""
    import ahocorasick

    found: dict[str, str] = {}
    for field in phrases.FIELDS:
        snake, kebab, tight = field.replace(" ", "_"), field.replace(" ", "-"), field.replace(" ", "")
        for s in {snake, tight, kebab}:
            found |= {f % s: SLOT for f in phrases.SNAKE}
        for o in phrases.OWNERS:
            found |= {"{{ %s.%s }}" % (o, snake): SLOT, "{{%s.%s}}" % (o, snake): SLOT}
        found |= {f % field: SLOT for f in phrases.SPACED} | {f % kebab: SLOT for f in phrases.KEBAB}
    found |= {s: "hint" for s in phrases.SLOT_HINTS if s not in found}
    found |= {s: FILLER for s in phrases.FILLER_SENTENCES}
    found |= {s: NOTICE for s in (*phrases.NOTICE, *phrases.NOTICE_ELSEWHERE)}
    found |= {s: PAGE for s in (*phrases.STATUS, *phrases.WRONG, *phrases.WRONG_ELSEWHERE)}
    found |= {s.replace(" ", by): PAGE for s in phrases.STATUS for by in ("", "_", "-") if " " in s}
    a = ahocorasick.Automaton()
    for phrase, kind in found.items():
        a.add_word(phrase, (kind, len(phrase)))
    # Words that filler is full of and other text is not: where three are met, paragraphs are weighed.
    for word in ("lorem", "ipsum", "velit", "cillum", "fugiat", "aliqua", "ligula", "ornare", "ullam", "mauris", "veniam", "voluptat", "perspiciatis", "accusam", "dolore", "vestibulum", "blah", "yada", " bla ", " xxx "):
        if word not in found:
            a.add_word(word, ("word", len(word)))
    a.make_automaton()
    return a


def _joins(a: str, b: str) -> bool:
    """Whether two neighbouring signs are of one word; scripts without blanks end none."""
    return a.isalnum() and b.isalnum() and a < "\u2e80" and b < "\u2e80"


def _within_word(text: str, begin: int, end: int) -> bool:
    """Whether a match begins or ends inside a longer word."""
    return (begin > 0 and _joins(text[begin - 1], text[begin])) or (end < len(text) and _joins(text[end - 1], text[end]))


def _covered(text: str, kinds: tuple[str, ...]) -> list[tuple[int, int, str]]:
    """Matches of ``kinds`` as disjoint stretches with the kind of their first."""
    spans = []
    for last, (kind, n) in automaton().iter(text):
        if kind in kinds and not _within_word(text, last + 1 - n, last + 1):
            spans.append((last + 1 - n, last + 1, kind))
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int, str]] = []
    for lo, hi, kind in spans:
        if out and lo < out[-1][1]:
            if hi > out[-1][1]:
                out[-1] = (out[-1][0], hi, out[-1][2])
        else:
            out.append((lo, hi, kind))
    return out


def _letters(text: str) -> int:
    return sum(map(str.isalpha, text))


def _is_neutral(word: str) -> bool:
    """A word of a page's grammar, or what is left of one in a script without blanks."""
    return len(word) == 1 or word in phrases.NEUTRAL or len(word) <= 2 and word > "\u2e80" or "-" in word and all(map(_is_neutral, word.split("-")))


def _weights(text: str) -> tuple[int, int]:
    """Letters of words that say something, and of those that pages are made of beside their phrases."""
    loose = neutral = 0
    for w in _WORD.findall(_WRAPPING.sub(" ", text)):
        if _is_neutral(w):
            neutral += len(w)
        else:
            loose += len(w)
    return loose, neutral


#: Before a phrase that leads its line in program text or data: signs of a comment, a value or a call.
_SAID = re.compile(r"^\s*(?:#|//|/\*|\*|--|;|<!--|\"{3}|'{3})|[\"'`(=]\s*$|[a-z_][\w.\])]*[\"'`]?\s*[:=]\s*[\"'`]?\w*")

#: The same where nothing else is said: comments, and words of program text that pass a phrase on.
_CALLED = re.compile(r"^\s*(?:#|//|/\*|\*|--|;)|[\"'`(=]\s*$|\b(?:echo|return|throw|raise|print\w*|puts|abort|assert|expect|const|let|var|def|fn|func|class|import|export|select|insert)\b")

_BLANK = "\ufeff \t\r\n"


def _leads(before: str) -> bool:
    """Whether what stands before a phrase on its line leaves it the line's first statement."""
    words = _WORD.findall(_WRAPPING.sub(" ", before))
    return not _SAID.search(before) and all(map(_is_neutral, words)) and phrases.CONDITIONAL.isdisjoint(words)


def _header_end(low: str) -> int:
    """Where a few lines of comment end, as a copy of another project's file has before the file itself."""
    at = lines = 0
    while lines < 3:
        end = low.find("\n", at)
        line = low[at : end if end >= 0 else len(low)]
        if end < 0 or line.strip() and not _COMMENT.match(line):
            break
        lines += bool(line.strip())
        at = end + 1
    return at


def is_page(low: str, prose: bool = False) -> bool:
    """Whether matches cover most of the text from some line to its end, and lead that line.

    Words of a page's grammar count for neither side, but phrases must be a part of all.
    A document that is no prose by its path is judged as a whole more readily.
    """
    least = COVERAGE if prose else WHOLE_COVERAGE
    marked, tagged = "<noscript" in low, low.lstrip(_BLANK)[:1] == "<"
    low = _ELEMENTS.sub(lambda m: "\n" * m.group().count("\n"), low)
    low = _TAG.sub(" ", low)
    spans = _covered(low, (PAGE, NOTICE))
    ends = [0, *(hi for _, hi, _ in spans)]
    gaps = [_weights(low[a:b]) for a, b in zip(ends, [*(lo for lo, _, _ in spans), len(low)])]
    before = list(accumulate(g[0] for g in gaps))
    head = _header_end(low)
    # Letters from each phrase on, and those that are matched, counted from the end.
    loose = matched = neutral = 0
    notices = True
    for i in range(len(spans) - 1, -1, -1):
        lo, hi, kind = spans[i]
        loose, neutral, matched = loose + gaps[i + 1][0], neutral + gaps[i + 1][1], matched + _letters(low[lo:hi])
        notices &= kind == NOTICE
        line = low.rfind("\n", 0, lo) + 1
        # The first phrase of a line speaks for it.
        if line < ends[i] or matched < least * (matched + loose) or matched < MATCHED * (matched + loose + neutral):
            continue
        lead = low[line:lo]
        own = _weights(lead)[0]
        said = 0 if line <= head else before[i] - own
        if not said:
            # The whole document: what stands before on the line is weighed with the rest.
            begins = low[line if line <= head else 0 :][:200].lstrip(_BLANK)[:1]
            if matched >= least * (matched + loose + own) and (begins in ("{", "[") or tagged or not _CALLED.search(lead)):
                return True
        elif matched >= COVERAGE * (matched + loose) and _leads(lead) and not (marked and notices and said > matched):
            return True
    return False


def _without_code(low: str) -> str:
    return _FENCE.sub(" ", low)


@lru_cache(32)
def _lexer(ending: str) -> re.Pattern[str]:
    """Comments and string literals of program text, so that none is looked for inside another."""
    marks = [r"(?P<block>/\*.*?(?:\*/|\Z))"] if ending not in _HASH or ending == "php" else []
    if ending in _TRIPLE:
        marks.append(r'(?P<triple>"""(?:\\.|(?!""").)*(?:"""|\Z)|' + r"'''(?:\\.|(?!''').)*(?:'''|\Z))")
    if ending in _TICK:
        marks.append(r"(?P<tick>`(?:\\.|[^`\\])*(?:`|\Z))")
    marks.append(r'(?P<string>"(?:\\.|[^"\\\n])*"|' + r"'(?:\\.|[^'\\\n])*')")
    if ending in _HASH:
        marks.append(r"(?P<hash>(?<![^\s;,)\]}])#[^\n]*)")
    if ending in _DASH:
        marks.append(r"(?P<dash>--[^\n]*)")
    elif ending not in _HASH and ending != "css" or ending == "php":
        marks.append(r"(?P<line>(?<!:)//[^\n]*)")
    return re.compile("|".join(marks), re.S)


_HEAD = re.compile(r"(?:[ \t\r]*(?:#[^\n]*)?\n)*[ \t]*")


def _is_docstring(text: str, begin: int) -> bool:
    """Whether what begins at ``begin`` is first on its line, and behind a block's colon or nothing but comments."""
    before = text[max(0, begin - 200) : begin]
    plain = before.rstrip()
    return "\n" in before[len(plain) :] and plain[-1:] == ":" and plain[-2:-1] not in ("'", '"') or begin == _HEAD.match(text).end()


def _lexed(text: str, ending: str) -> Iterator[tuple[int, int, bool]]:
    """Comments and docstrings (True), and values that stand alone behind their name (False)."""
    for m in _lexer(ending).finditer(text):
        lo, hi = m.span()
        if m.lastgroup == "block" and not text.endswith("*/", lo, hi):
            continue
        if m.lastgroup not in ("string", "triple", "tick"):
            yield lo, hi, True
        elif ending in ("py", "pyi") and _is_docstring(text, lo):
            yield lo, hi, True
        elif _NAMED.search(text[max(0, lo - 40) : lo]) and _ENDS.match(text, hi):
            yield lo, hi, False


_OPEN_SLOT = re.compile("|".join(phrases.OPEN_SLOTS))


def _slots(text: str) -> Iterator[tuple[int, int]]:
    """Slots by their names, and those with any words in a scaffold's own syntax."""
    hinted = False
    for last, (kind, n) in automaton().iter(text):
        lo, hi = last + 1 - n, last + 1
        hinted |= kind == "hint"
        if kind != SLOT or _within_word(text, lo, hi) or (text[lo] == "_" and lo and text[lo - 1] == "_") or (text[hi - 1] == "_" and hi < len(text) and text[hi] == "_"):
            continue
        yield lo, hi
    if hinted:
        for m in _OPEN_SLOT.finditer(text):
            yield m.span()


def has_open_slot(low: str, code: bool, ending: str = "", raw: str = "") -> bool:
    """Whether a slot stands outside code spans; in program text, in a comment or docstring."""
    text = _without_code(low)
    said: list[tuple[int, int]] | None = None
    for lo, hi in _slots(text):
        if not code:
            return True
        begin, end = text.rfind("\n", 0, lo) + 1, text.find("\n", hi)
        if _COMMENT.match(text[begin : end if end >= 0 else len(text)]):
            return True
        if said is None:
            said = [(a, b) for a, b, spoken in _lexed(text, ending) if spoken]
            cased = _without_code(raw) if len(raw) == len(low) else text
        # Of Python's own names (``__version__``) docstrings and comments may speak.
        if any(a <= lo and hi <= b for a, b in said) and not (ending in ("py", "pyi") and cased[lo:hi].startswith("__") and cased[lo:hi] == text[lo:hi]):
            return True
    return False


def _is_filler(unit: str) -> bool:
    words = _WORD.findall(unit)
    if not words:
        return False
    mash = sum(len(w) for m in _MASH.finditer(unit + " ") for w in _WORD.findall(m.group()))
    letters = sum(map(len, words))
    if mash >= COVERAGE * letters:
        return True
    noise = [w for w in words if w in phrases.NOISE]
    if len(noise) >= FILLER_WORDS and sum(map(len, noise)) >= COVERAGE * letters:
        return True
    # Latin that goes on from the well-known words: they are part of it, and the others end as Latin does.
    known = [w for w in words if w in phrases.LATIN]
    latin = sum(len(w) for w in words if w in phrases.LATIN or len(w) > 3 and w.endswith(phrases.LATIN_ENDINGS))
    if len(known) >= FILLER_WORDS and len({w for w in known if len(w) > 3}) >= 3 and latin >= COVERAGE * letters and sum(map(len, known)) >= COVERAGE / 2 * letters:
        return True
    spans = [(lo, hi) for lo, hi, _ in _covered(unit, (FILLER,))]
    return len(spans) >= FILLER_SENTENCES and sum(_letters(unit[lo:hi]) for lo, hi in spans) >= COVERAGE * letters


def _comment_blocks(low: str) -> Iterator[str]:
    block: list[str] = []
    for line in low.splitlines():
        m = _COMMENT.match(line)
        if m:
            block.append(m.group(1))
        elif block:
            # A filler comment is wrapped anywhere, also within a word.
            yield "\n".join(block)
            block = []
    if block:
        yield "\n".join(block)


def _spoken_filler(body: str) -> bool:
    """Whether a paragraph of a comment or docstring is filler, its signs left out."""
    for part in _COMMENT_BREAK.split(body.strip("\"'")):
        plain = _COMMENT_SIGNS.sub("", part)
        if any(_is_filler(plain.replace("\n", by)) for by in (" ", "")):
            return True
    return False


def has_filler(low: str, code: bool, ending: str = "", values: bool = True) -> bool:
    """Whether filler covers most of a paragraph, element or value; in program text, of a
    comment, a paragraph of it or of a docstring, or of a value.

    A value in program text needs FILLER_WORDS words, since labels read like short filler,
    and the program must not make or test filler itself.
    """
    if not code:
        return any(_is_filler(u) for u in _UNITS.split(_without_code(low)) if u)
    for b in _comment_blocks(low):
        for part in (b, *re.split(r"\n\s*\n", b)):
            if any(_is_filler(part.replace("\n", by)) for by in (" ", "")):
                return True
    values = values and not _MAKER.search(low)
    for lo, hi, spoken in _lexed(low, ending):
        if spoken:
            if _spoken_filler(low[lo:hi]):
                return True
        elif values:
            unit = low[lo:hi].strip("\"'`")
            if len(_WORD.findall(unit)) >= FILLER_WORDS and any(_is_filler(u) for u in re.split(r"\n\s*\n|(?:\\n){2}", unit)):
                return True
    return False


def is_template_path(path: str) -> bool:
    *folders, name = path.lower().split("/")
    return not TEMPLATE_FOLDERS.isdisjoint(folders) or name.endswith(TEMPLATE_ENDINGS) or any(f".{x}." in name for x in ("tmpl", "tpl", "template", "j2"))


def is_licence_path(path: str) -> bool:
    return re.match(r"(licen[cs]es?|copying|notice|unlicense)(\.|$|-)", path.lower().rpartition("/")[2]) is not None


def kinds_of(text: str | None, path: str | None) -> list[str]:
    """Which residue a file has, in order: slot, page (error or script notice), filler.

    Null, empty and blank texts, licence files and files kept as templates have none.
    A null path is that of a plain text file.
    """
    if not text or text.isspace():
        return []
    path = path or ""
    if is_licence_path(path):
        return []
    low = text.lower()
    seen: dict[str, int] = {}
    for _, (kind, _n) in automaton().iter(low):
        seen[kind] = seen.get(kind, 0) + 1
    ending = path.rpartition(".")[2].lower()
    code = ending in _CODE
    template = is_template_path(path)
    found = []
    if (SLOT in seen or "hint" in seen) and not template and has_open_slot(low, code, ending, text):
        found.append(SLOT)
    if (PAGE in seen or NOTICE in seen) and is_page(low, ending in _PROSE):
        found.append(PAGE)
    if (FILLER in seen or seen.get("word", 0) >= 3 or _MASH.search(low)) and not template and has_filler(low, code, ending, not _TEST_PATH.search(path.lower())):
        found.append(FILLER)
    return found


def residue(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = "file_path") -> DataFrame:
    """``key, kinds``: the rows of ``df`` with residue, one for each such row; no shuffle.

    Nulls and empty texts have none; columns beside the three are ignored; a repeated
    row is repeated; an empty table gives no rows.
    """
    schema = T.StructType([df.schema[key], T.StructField("kinds", T.ArrayType(T.StringType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [kinds_of(t.as_py(), p.as_py()) for t, p in zip(batch.column(1), batch.column(2))]
            rows = [i for i, k in enumerate(kinds) if k]
            if rows:
                yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array([kinds[i] for i in rows], pa.list_(pa.string()))], names=[key, "kinds"])

    return df.select(key, text, path).mapInArrow(work, schema)
