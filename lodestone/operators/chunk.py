"""Chunking of files: windows of lines, splitting of long chunks, definitions of Python sources."""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import lines, only_comments
from lodestone.params import DEFAULTS


def sliding_windows(files: DataFrame, size: int = DEFAULTS.window_lines, overlap: int = DEFAULTS.overlap_lines) -> DataFrame:
    """(path, content) to (path, start_line, end_line, content): windows of ``size`` lines that share ``overlap``, up
    to the first that reaches the end; windows of blank and comment lines only are dropped."""
    step = size - overlap
    split = files.select("path", lines(F.col("content")).alias("ls"))
    starts = F.transform(F.sequence(F.lit(0), F.ceil(F.greatest(F.size("ls") - size, F.lit(0)) / step).cast("int")), lambda i: i * step)
    windows = split.select("path", "ls", F.explode(starts).alias("s"))
    out = windows.select("path", (F.col("s") + 1).alias("start_line"), F.least(F.col("s") + size, F.size("ls")).alias("end_line"), F.array_join(F.slice("ls", F.col("s") + 1, F.lit(size)), "\n").alias("content"))
    return out.where(~only_comments(F.col("content")))


def split_long(chunks: DataFrame, most: int = DEFAULTS.max_chunk_chars, carried: tuple[str, ...] = ()) -> DataFrame:
    """(path, start_line, end_line, content, carried columns) to pieces of whole lines, packed greedily up to ``most``
    characters; a longer line stays whole; chunks that fit stay as they are; a last piece of comments only is dropped."""
    cut = F.aggregate(
        F.transform(lines(F.col("content")), F.length),
        F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(-1).alias("held"), F.lit(0).alias("i")),
        lambda s, n: F.struct(
            F.when((s["held"] >= 0) & (s["held"] + 1 + n > most), F.array_append(s["cuts"], s["i"])).otherwise(s["cuts"]).alias("cuts"),
            F.when((s["held"] >= 0) & (s["held"] + 1 + n <= most), s["held"] + 1 + n).otherwise(n).alias("held"),
            (s["i"] + 1).alias("i"),
        ),
        lambda s: s["cuts"],
    )
    cuts = F.when(F.length("content") > most, cut).otherwise(F.array().cast("array<int>"))
    d = chunks.select("path", *carried, "start_line", "end_line", lines(F.col("content")).alias("ls"), cuts.alias("cuts"))
    edges = F.arrays_zip(F.concat(F.array(F.lit(0)), "cuts").alias("a"), F.concat("cuts", F.array(F.size("ls"))).alias("b"))
    d = d.select("path", *carried, "start_line", "end_line", "ls", F.size("cuts").alias("n"), F.posexplode(edges).alias("piece", "e"))
    last = F.col("piece") == F.col("n")
    d = d.select(
        "path",
        *carried,
        "piece",
        (F.col("start_line") + F.col("e.a")).alias("start_line"),
        F.when(last, F.col("end_line")).otherwise(F.col("start_line") + F.col("e.b") - 1).alias("end_line"),
        F.array_join(F.slice("ls", F.col("e.a") + 1, F.col("e.b") - F.col("e.a")), "\n").alias("content"),
        (last & (F.col("n") > 0)).alias("tail"),
    )
    return d.where(~(F.col("tail") & only_comments(F.col("content")))).drop("tail")


def is_code(line: str) -> bool:
    return bool(line.strip()) and not line.strip().startswith(("#", "//"))


def python_definitions(source: str, stem: str = "module") -> list[tuple[int, int, str, str, str | None]] | None:
    """(first line, last line, name, kind, parent) of top-level functions, classes (their head) and methods; runs of
    two or more code lines between them as ``module``, called by the file's ``stem``. None where the source does not
    parse, or nests too deep for the parser."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    text = source.split("\n")
    first = lambda n: min([n.lineno, *[d.lineno for d in getattr(n, "decorator_list", [])]])
    out, done = [], 0

    def gap(upto: int) -> None:
        if sum(map(is_code, text[done:upto])) >= 2:
            out.append((done + 1, upto, stem, "module", None))

    for node in tree.body:
        if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            continue
        gap(first(node) - 1)
        done = node.end_lineno
        if isinstance(node, ast.ClassDef):
            members = [m for m in node.body if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
            at = first(node)
            for m in members:
                if first(m) > at:
                    if any(map(is_code, text[at - 1 : first(m) - 1])):
                        out.append((at, first(m) - 1, node.name, "class", None))
                out.append((first(m), m.end_lineno, m.name, "method", node.name))
                at = m.end_lineno + 1
            if at <= node.end_lineno and any(map(is_code, text[at - 1 : node.end_lineno])):
                out.append((at, node.end_lineno, node.name, "class", None))
        else:
            out.append((first(node), node.end_lineno, node.name, "function", None))
    gap(len(text))
    return out


#: Files whose chunks a task has at once.
PARSED_FILES = 64
_TOKEN = re.compile(r"""//[^\n]*|/\*(?:.*?\*/|.*)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[\w$]+|\s+|.""", re.S)
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: Words after which a slash begins a regular expression; after other words, numbers, ``)`` and ``]`` it divides.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield"}


def quiet(source: str) -> str:
    """JavaScript or TypeScript with its comments, strings, regular expressions and the texts of its templates blanked, line
    feeds kept; what stands in ``${}`` stays, with its brackets. A quote that its line does not close (as in the text of a
    tag) is a character like any other, and ``://`` begins no comment."""
    out, at, before, open_ = [], 0, "", []  # open_: for each open brace, whether it is a template's
    blank = lambda s: re.sub(r"[^\n]", " ", s)

    def template(at: int) -> int:
        text = _TEMPLATE.match(source, at)[0]
        out.append(blank(text))
        at += len(text)
        if source.startswith("${", at):
            open_.append(True)
            out.append(" {")
            return at + 2
        out.append(" " * (at < len(source)))
        return at + 1

    while at < len(source):
        token = _TOKEN.match(source, at)[0]
        if token[0] == "`":
            out.append(" ")
            at, before = template(at + 1), "x"
            continue
        if token == "/" and (not before or before in _BEFORE_REGEX or not (before[-1].isalnum() or before[-1] in "_$)]\"'")) and (found := _REGEX.match(source, at)):
            token = found[0]
            out.append(blank(token))
            before = "x"
        elif token == "}" and open_ and open_.pop():
            out.append("}")
            at, before = template(at + 1), "x"
            continue
        elif token[:2] == "//" and source[at - 1 : at] == ":":
            token = "//"
            out.append(token)
        elif token[:2] in ("//", "/*") and len(token) > 1:
            out.append(blank(token))
        elif token[0] in "\"'" and len(token) > 1:
            out.append(blank(token))
            before = token
        else:
            if token == "{":
                open_.append(False)
            out.append(token)
            before = token if not token.isspace() else before
        at += len(token)
    return "".join(out)


_VALUE = r"=\s*(?:async\s*)?(?:function\b|\([^)]*\)[^=;{]*=>|[\w$]+\s*=>)"
_TOP = re.compile(
    r"[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:(?:async|abstract)\s+)*"
    r"(?:(?P<function>function)\b\s*\*?\s*(?P<f>[\w$]*)|(?P<class>class)\b\s*(?P<c>(?!extends\b|implements\b)[\w$]*)|(?P<interface>interface)\s+(?P<i>[\w$]+)|(?:const\s+)?(?P<enum>enum)\s+(?P<e>[\w$]+)"
    r"|(?P<space>namespace|module)\s+(?P<n>[\w$.]+)\s*\{|(?P<type>type)\s+(?P<t>[\w$]+)[^=;{]*=|(?:const|let|var)\s+(?P<v>[\w$]+)[^=;{]*" + _VALUE
    + r"|(?:const|let|var)\s+(?P<w>[\w$]+)[^=;{(]*=\s*(?:await\s+)?[\w$.]+\s*(?:<[^>\n]*>)?\(|(?:module\s*\.\s*)?exports(?:\.(?P<x>[\w$]+))?\s*" + _VALUE + r"|[\w$.]+\.prototype\.(?P<p>[\w$]+)\s*" + _VALUE
    + r"|export\s+default\s+(?P<d>(?:async\s+)?\([^)]*\)[^=;{]*=>|[\w$.]+\())"
)
_MEMBER = re.compile(r"[ \t]*(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)[ \t]+)*\*?[ \t]*(?P<name>#?[\w$]+)\s*(?:(?:<[^>\n]*>)?\(|(?::[^=\n]+)?" + _VALUE + ")")
_CONTINUED = re.compile(r"\s*[.?:&|+)]")
_BRACKET = re.compile(r"[()\[\]{}\n]")
_END = re.compile(r"[()\[\]{};\n]|[^\s()\[\]{};]+")
_NO_MEMBER = {"if", "for", "while", "switch", "catch", "return", "function", "super", "new", "await", "throw"}


class _Script:
    """A script's lines, its blanked text, and how deep in brackets each line begins.

    Where the brackets of the file do not match, a definition that begins without indentation begins at depth 0: what
    stands open before it is lost to the definition it stands in, and to no other."""

    def __init__(self, source: str):
        self.text, self.quiet = source.split("\n"), quiet(source)
        self.starts = [0]
        for line in self.text:
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.resumed: list[int] = []
        self.depths, closed = self._depths(False)
        if not closed:
            self.depths, _ = self._depths(True)

    def _depths(self, resume: bool) -> tuple[list[int], bool]:
        depth, depths, good = 0, [0], True
        for m in _BRACKET.finditer(self.quiet):
            if m[0] == "\n":
                if resume and depth and self.quiet[m.end() : m.end() + 1].strip() and _TOP.match(self.quiet, m.end()):
                    depth = 0
                    self.resumed.append(len(depths))
                depths.append(depth)
            else:
                depth += 1 if m[0] in "([{" else -1
                if depth < 0:
                    depth, good = 0, False
        return depths, good and not depth

    def end_of(self, at: int, body: bool, limit: int) -> int:
        """The line (from 1) on which what begins at ``at`` ends: by the bracket that closes its body, a semicolon, or,
        without a body, the end of a line that nothing continues; not beyond line ``limit``."""
        level, said, stop = 0, False, self.starts[limit]
        for m in _END.finditer(self.quiet, at, stop):
            ch = m[0]
            if ch in ("(", "[", "{"):
                level += 1
            elif ch in (")", "]", "}"):
                level -= 1
                if level < 0:
                    return bisect.bisect_right(self.starts, m.start())
            if ch != "\n":
                said = True
            if level == 0 and ch in ("}", ";") or not body and level == 0 and said and ch == "\n" and not _CONTINUED.match(self.quiet, m.start()):
                return bisect.bisect_right(self.starts, m.start())
        return limit

    def definitions(self, first_line: int, last_line: int, depth: int, stem: str) -> list[tuple[int, int, str, str, str | None]]:
        """Those of lines first_line (from 0) to last_line that stand ``depth`` deep, and the code between them."""
        out: list[tuple[int, int, str, str, str | None]] = []
        done = line = first_line

        def between(upto: int) -> None:
            if sum(map(is_code, self.text[done:upto])) >= 2:
                out.append((done + 1, upto, stem, "module", None))

        while line < last_line:
            found = _TOP.match(self.quiet, self.starts[line]) if self.depths[line] == depth else None
            if not found:
                line += 1
                continue
            limit = next((i for i in self.resumed if line < i < last_line), last_line)
            kind = next((k for k in ("function", "class", "interface", "enum", "type", "space") if found[k]), "function")
            name = next((found[k] for k in "fcietvwxpn" if found[k]), None) or "default"
            valued = found["t"] or found["v"] or found["x"] or found["p"] or (found["d"] or "").endswith("=>")
            called = found["w"] or (found["d"] or "").endswith("(")
            braced = not (valued or called) or self.quiet[found.end() :][:200].lstrip().startswith("{") or found[0].endswith("function")
            start = found.end() if valued else found.end() - 1 if called or kind == "space" else found.start()
            last = self.end_of(start, braced, limit)
            if called and not re.search(r"=>|\bfunction\b", self.quiet[found.start() : self.starts[last]]):
                line += 1  # a call that is given no function
                continue
            first = line
            while first > done and self.text[first - 1].lstrip().startswith("@"):
                first -= 1
            between(first)
            if kind == "space":
                out += self.definitions(line + 1, last - 1, depth + 1, stem)
            elif kind == "class":
                out += self.members(first, line, last, name, depth + 1)
            else:
                out.append((first + 1, last, name, kind, None))
            done = line = max(last, line + 1)
        between(last_line)
        return out

    def members(self, first: int, line: int, last: int, name: str, depth: int) -> list[tuple[int, int, str, str, str | None]]:
        """A class's methods, and the lines before, between and after them as pieces of the class."""
        out: list[tuple[int, int, str, str, str | None]] = []
        at, inner = first + 1, line + 1

        def head(a: int, b: int) -> None:
            if a <= b and any(map(is_code, self.text[a - 1 : b])):
                out.append((a, b, name, "class", None))

        while inner < last:
            member = _MEMBER.match(self.quiet, self.starts[inner]) if self.depths[inner] == depth else None
            if member and member["name"] not in _NO_MEMBER:
                stop = self.end_of(member.start(), True, last)
                begin = inner
                while begin > at - 1 and self.text[begin - 1].lstrip().startswith("@"):
                    begin -= 1
                head(at, begin)
                out.append((begin + 1, stop, member["name"], "method", name))
                at, inner = stop + 1, max(stop, inner + 1)
            else:
                inner += 1
        head(at, last)
        return out


def script_definitions(source: str, stem: str = "module") -> list[tuple[int, int, str, str, str | None]]:
    """The same of JavaScript and TypeScript, with interfaces, enums, types, constants that hold a function or the result
    of a call that is given one, exported functions and what stands in namespaces."""
    script = _Script(source)
    return script.definitions(0, len(script.text), 0, stem)


def syntax_chunks(files: DataFrame) -> DataFrame:
    """(path, content, language if there are others than python) to their definitions as chunks; unparsable files give
    one row of kind ``unparsed`` for the window chunker. A parser is the one thing here that needs Python on the
    executors."""

    schema = pa.schema([("path", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("name", pa.string()), ("chunk_type", pa.string()), ("parent", pa.string()), ("content", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (batch.slice(i, PARSED_FILES) for batch in batches for i in range(0, batch.num_rows, PARSED_FILES)):
            rows = []
            for path, content, language in zip(*(some.column(i).to_pylist() for i in range(3)), strict=True):
                text = (content or "").replace("\r\n", "\n").replace("\r", "\n")
                stem = path.replace("\\", "/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
                found = python_definitions(text, stem) if language == "python" else script_definitions(text, stem)
                ls = text.split("\n")
                if not found:
                    rows.append((path, 1, len(ls), path, "unparsed", None, text))
                for a, b, name, kind, parent in found or []:
                    rows.append((path, a, b, name, kind, parent, "\n".join(ls[a - 1 : b])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    language = F.col("language") if "language" in files.columns else F.lit("python")
    return files.select("path", "content", language.alias("language")).mapInArrow(run, "path string, start_line int, end_line int, name string, chunk_type string, parent string, content string")
