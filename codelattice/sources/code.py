"""Reading code: repository walks, Go and TypeScript declarations, manifests, diffs, logs, advisories.

No syntax-tree library is at hand, so declarations are taken line by line with regular
expressions on text whose comments and strings are blanked out first; nesting is followed
by braces.  What that cannot see (types behind calls through variables, macros, generated
names) is left unresolved, never guessed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

SYMBOLS = "repo_id string, branch string, file_path string, kind string, symbol_path string, line_start int, line_end int, signature string, exported boolean, structural_hash string, calls array<string>"
_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.)*'", re.S)
_GO = re.compile(r"^func\s+(?:\(\s*(?:\w+\s+)?\*?(\w+)[^)]*\)\s*)?(\w+)|^type\s+(\w+)\s+(struct|interface|\S+)|^(?:var|const)\s+(\w+)")
_TS = re.compile(r"^(export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:(function)\*?\s+(\w+)|(class|interface|enum|type)\s+(\w+)|(const|let|var)\s+(\w+))")
_TS_MEMBER = re.compile(r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|readonly\s+|override\s+)*(?:async\s+)?\*?(#?\w+)\s*(?:<[^>]*>)?\(")
_CALL = re.compile(r"(?<![\w.])((?:\w+\.)*\w+)\s*\(")
_TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|\"\"|[^\s\w]")
#: Words before a bracket that are no calls.
_NO_CALL = frozenset("if for switch return func function while catch new typeof import export const let var range defer go select case else await async type struct interface map".split())

#: Types that have no methods of their own.
_PLAIN = frozenset("bool byte complex128 complex64 error float32 float64 int int16 int32 int64 int8 rune string uint uint16 uint32 uint64 uint8 uintptr any func map chan interface struct".split())


def blanked(text: str) -> str:
    """Comments and strings as blanks, line for line; empty strings stay as two quotes."""
    return _BLANK.sub(lambda m: ('""' if m[0][0] in "\"'`" else " ") + "\n" * m[0].count("\n"), text)


def structural_hash(code: str) -> str:
    """Equal for code that differs in names, literals and comments only: names become the place they first stood at."""
    names: dict[str, str] = {}
    out = []
    for t in _TOKEN.findall(blanked(code)):
        if t[0].isdigit():
            out.append("#")
        elif t == '""':
            out.append('"')
        elif (t[0].isalpha() or t[0] == "_") and t not in _NO_CALL:
            out.append(names.setdefault(t, f"n{len(names)}"))
        else:
            out.append(t)
    return hashlib.sha256(" ".join(out).encode()).hexdigest()[:32]


def receiver_types(text: str, returns: dict[str, str]) -> dict[str, str]:
    """Types of a Go function's receiver, parameters and local variables, as far as its own text tells them.

    ``returns`` are the types that the file's constructors give; a variable made by another
    package's ``New`` function stands for that package.
    """
    known: dict[str, str] = {}
    head = text.split("{", 1)[0]
    for names, kind in re.findall(r"([\w, ]+?)\s+(?:\.\.\.)?\*?((?:\w+\.)?[A-Za-z_]\w*)(?=\s*[,)])", head):
        for name in names.split(","):
            if kind not in _PLAIN and name.split():
                known[name.split()[-1]] = kind
    for name, kind in re.findall(r"\bvar\s+(\w+)\s+\*?((?:\w+\.)?[A-Za-z_]\w*)", text):
        if kind not in _PLAIN:
            known[name] = kind
    for name, kind in re.findall(r"\b(\w+)(?:\s*,\s*\w+)?\s*:=\s*&?((?:\w+\.)?[A-Z]\w*)\{", text):
        known[name] = kind
    for name, made in re.findall(r"\b(\w+)(?:\s*,\s*\w+)?\s*:=\s*((?:\w+\.)?\w+)\(", text):
        if made in returns:
            known[name] = returns[made]
        elif re.fullmatch(r"\w+\.New\w*", made):
            known[name] = made.split(".")[0]
    return known


def _span(lines: list[str], at: int) -> int:
    """Last line of the declaration that starts at a line, by braces and brackets."""
    depth, seen = 0, False
    for i in range(at, len(lines)):
        for c in lines[i]:
            if c in "{(":
                depth += 1
                seen = seen or c == "{"
            elif c in "})":
                depth -= 1
        if depth <= 0 and (seen or i == at and "{" not in lines[i]):
            return i
    return len(lines) - 1


def declarations(path: str, language: str | None, content: str | None) -> list[tuple]:
    """(kind, symbol, first line, last line, signature, exported, structural hash, called names) of a file."""
    if not content:
        return []
    text = content.lstrip("﻿").replace("\r\n", "\n")
    raw, code = text.split("\n"), blanked(text).split("\n")
    go = (language or "").lower() == "go" or path.endswith(".go")
    found, owner, owner_end = [], None, -1
    # what the file's constructors give, and of which types its structs' fields are
    returns = {m[1]: m[2] for m in re.finditer(r"(?m)^func\s+(\w+)\s*\([^\n]*?\)\s*\(?\s*\*?(\w+)", "\n".join(code)) if m[2] not in _PLAIN} if go else {}
    struct_fields: dict[str, dict[str, str]] = {}
    if go:
        for m in re.finditer(r"(?ms)^type\s+(\w+)\s+struct\s*\{(.*?)^\}", "\n".join(code)):
            struct_fields[m[1]] = {f[0]: f[1] for f in re.findall(r"(?m)^\s+(\w+)\s+\*?((?:\w+\.)?\w+)\s*(?:\"\"|$)", m[2]) if f[1] not in _PLAIN}

    def add(kind: str, symbol: str, i: int, exported: bool, end: int | None = None) -> int:
        end = _span(code, i) if end is None else end
        calls = []
        if kind in ("function", "method"):
            body = "\n".join(code[i : end + 1])[len(code[i].split("{")[0]) :]
            calls = [c for c in _CALL.findall(body) if c.split(".")[0] not in _NO_CALL]
            if go:
                typed = receiver_types("\n".join(code[i : end + 1]), returns)
                fields = {**typed, **{f"{v}.{f}": t for v, owner_type in typed.items() for f, t in struct_fields.get(owner_type, {}).items()}}
                calls = [f"{fields[c.rsplit('.', 1)[0]]}.{c.rsplit('.', 1)[1]}" if "." in c and c.rsplit(".", 1)[0] in fields else c for c in calls]
            calls = list(dict.fromkeys(calls))
        shape = structural_hash("\n".join(raw[i : end + 1])) if kind in ("function", "method", "struct", "interface", "class", "type") else None
        found.append((kind, symbol, i + 1, end + 1, raw[i].split("{")[0].strip(), exported, shape, calls))
        return end

    for i, line in enumerate(code):
        if go:
            m = _GO.match(line)
            if m and m[2]:
                add("method" if m[1] else "function", f"{m[1]}.{m[2]}" if m[1] else m[2], i, m[2][:1].isupper())
            elif m and m[3]:
                kind = m[4] if m[4] in ("struct", "interface") else "type"
                end = add(kind, m[3], i, m[3][:1].isupper())
                if kind == "interface":
                    for j in range(i + 1, end):
                        k = re.match(r"^\s+(\w+)\(", code[j])
                        if k:
                            add("method", f"{m[3]}.{k[1]}", j, k[1][:1].isupper(), j)
            elif m and m[5]:
                add("variable", m[5], i, m[5][:1].isupper())
            continue
        m = _TS.match(line)
        if m and (m[3] or m[5] or m[7]):
            kind = "function" if m[3] else {"class": "class", "interface": "interface"}.get(m[4], "type") if m[5] else "variable"
            name = m[3] or m[5] or m[7]
            end = add(kind, name, i, bool(m[1]))
            if kind == "class":
                owner, owner_end = name, end
        elif owner and i <= owner_end:
            k = _TS_MEMBER.match(line)
            if k and k[1] not in _NO_CALL and line.rstrip().endswith("{"):
                add("method", f"{owner}.{k[1]}", i, not k[1].startswith("#"))
    return found


def parse_sources(files: DataFrame) -> DataFrame:
    """Symbols of (repo_id, branch, file_path, language, content), with what each calls by name.

    Files of other languages, null and empty contents give no rows; a file that can't be
    followed gives the declarations found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["repo_id", "branch", "file_path"]
        kinds = [pa.string()] * 5 + [pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string())]
        for b in batches:
            rows = []
            for r, br, p, lang, c in zip(*(b.column(x).to_pylist() for x in [*names, "language", "content"]), strict=True):
                rows += [(r, br, p, *d) for d in declarations(p or "", lang, c)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.strip().split(" ")[0] for x in SYMBOLS.split(", ")])

    keep = F.coalesce(F.lower("language"), F.lit("")).isin("go", "typescript", "javascript") | F.col("file_path").rlike(r"\.(go|tsx?|jsx?)$")
    return files.where(keep).select("repo_id", "branch", "file_path", "language", "content").mapInArrow(run, SYMBOLS)


def imports(files: DataFrame) -> DataFrame:
    """(repo_id, branch, file_path, import_path, alias) of Go and TypeScript files, JVM-side."""
    go = F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:import\s+)?(?:(?:\w+|\.|_)\s+)?\"([\w./~-]+)\"\s*$"), 1)
    ts = F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:import|export)\b[^'\"\n]*\bfrom\s+['\"]([^'\"]+)['\"]"), 1)
    found = F.when(F.col("file_path").endswith(".go"), go).otherwise(ts)
    return files.where("content IS NOT NULL").select("repo_id", "branch", "file_path", F.explode(F.array_distinct(found)).alias("import_path")).withColumn("alias", F.regexp_extract("import_path", r"([^/]+?)(?:\.\w+)?$", 1))


#: What is ignored unless a repository says otherwise.
IGNORED = ("vendor/", "node_modules/", ".git/", ".hg/", ".svn/", "dist/", "build/", "out/", "__pycache__/", "*.pb.go", "*.gen.go", "testdata/", ".claude/", ".cursor/", ".aider*/")


def walk(spark: SparkSession, root: str, ignore: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """Text files under a folder as (file_path, content): no ignored and no binary ones; larger ones only where ``max_bytes`` lets them out.

    ``ignore`` has the lines of the repository's ignore file; they come after the usual ones, so they may let files in again.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.col("path"), "^file:/+", "/")
    rel = F.expr(f"substring(path_, {len(root.rstrip('/').removeprefix('file://')) + 2})")
    rows = files if max_bytes is None else files.where(F.col("length") <= max_bytes)
    rows = rows.withColumn("path_", base).withColumn("file_path", rel).where(~is_ignored(F.col("file_path"), [*IGNORED, *(ignore or [])]))
    return rows.where(F.is_valid_utf8(F.col("content").cast("string")) & (F.instr(F.col("content").cast("string"), "\0") == 0)).select("file_path", F.col("content").cast("string").alias("content"))


def ignore_regex(pattern: str) -> str:
    """A pattern of an ignore file as a regular expression over one entry: a relative path, a folder's with a slash behind."""
    folder, p = pattern.endswith("/"), pattern.rstrip("/")
    anchored = "/" in p
    out, at, p = "", 0, p.lstrip("/")
    while at < len(p):
        if p.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif p.startswith("**", at):
            out, at = out + ".*", at + 2
        elif p[at] == "[" and "]" in p[at + 2 :]:
            end = p.index("]", at + 2)
            out, at = out + "[" + p[at + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, at = out + {"*": "[^/]*", "?": "[^/]"}.get(p[at], re.escape(p[at])), at + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/$" if folder else "/?$")


def is_ignored(path: Column, lines: list[str] | tuple[str, ...]) -> Column:
    """Whether the lines of an ignore file leave a path out: the last line that matches counts, ``!`` lets in again, but nothing below a folder that is out."""
    rules = [x.strip() for x in lines if x.strip() and not x.strip().startswith("#")]

    def verdict(entry: Column) -> Column:
        out = F.lit(False)
        for r in rules:
            out = F.when(entry.rlike(ignore_regex(r.removeprefix("!"))), F.lit(not r.startswith("!"))).otherwise(out)
        return out

    parts = F.split(path, "/")
    above = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    return F.coalesce(F.exists(above, verdict) | verdict(path), F.lit(False))


def manifest(files: DataFrame) -> DataFrame:
    """(repo_id, module_path, name, version) of go.mod files: the module and what it requires, not what it excludes, replaces or retracts."""
    m = files.where(F.col("file_path").rlike(r"(^|/)go\.mod$") & F.col("content").isNotNull())
    text = F.regexp_replace(F.regexp_replace("content", "\r", ""), r"//[^\n]*", "")
    text = F.regexp_replace(text, r"(?m)^[ \t]*(?:exclude|replace|retract|tool|ignore|godebug)[ \t]*\([^)]*\)", "")
    text = F.regexp_replace(text, r"(?m)^[ \t]*(?:exclude|replace|retract|tool|ignore|godebug)[ \t][^\n]*", "")
    line = r"(?m)^[ \t]*(?:require[ \t]+)?\"?([^\s()\"]+)\"?[ \t]+(v\d[^\s]*)[ \t]*$"
    need, vers = (F.regexp_extract_all(text, F.lit(line), i) for i in (1, 2))
    rows = m.select("repo_id", F.regexp_extract(text, r'(?m)^[ \t]*module[ \t]+"?([^\s"]+)', 1).alias("module_path"), F.explode(F.arrays_zip(need.alias("name"), vers.alias("version"))).alias("d"))
    return rows.select("repo_id", "module_path", "d.name", "d.version")


def added_lines(patches: DataFrame) -> DataFrame:
    """(repo_id, git_sha, file_path, line_no, text): lines that unified diffs add, numbered in the new file."""
    from pyspark.sql import Window

    rows = patches.select("repo_id", "git_sha", F.posexplode(F.split("patch", "\n")).alias("i", "t"))
    w = Window.partitionBy("repo_id", "git_sha").orderBy("i")
    path = F.last(F.when(F.col("t").startswith("+++ "), F.regexp_replace("t", r"^\+\+\+ (?:b/)?", "")), ignorenulls=True).over(w)
    hunk = F.regexp_extract("t", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    r = rows.withColumn("file_path", path).withColumn("hunk", F.count(F.when(hunk != "", 1)).over(w)).withColumn("first", F.last(F.when(hunk != "", hunk.cast("int")), ignorenulls=True).over(w))
    body = r.where(F.col("hunk") > 0).withColumn("new", F.col("t").rlike(r"^[+ ]") & ~F.col("t").startswith("+++ "))
    w2 = Window.partitionBy("repo_id", "git_sha", "hunk").orderBy("i")
    body = body.withColumn("k", F.count(F.when(F.col("new"), 1)).over(w2))
    return body.where(F.col("t").startswith("+") & F.col("new") & (F.col("file_path") != "/dev/null")).select("repo_id", "git_sha", "file_path", (F.col("first") + F.col("k") - 1).alias("line_no"), F.expr("substring(t, 2)").alias("text"))


_EVENT = StructType([StructField(x, StringType()) for x in ("introduced", "fixed", "last_affected")])
ADVISORY = StructType([
    StructField("id", StringType()), StructField("aliases", ArrayType(StringType())), StructField("summary", StringType()),
    StructField("affected", ArrayType(StructType([StructField("package", StructType([StructField("ecosystem", StringType()), StructField("name", StringType())])), StructField("ranges", ArrayType(StructType([StructField("type", StringType()), StructField("events", ArrayType(_EVENT))])))]))),
    StructField("severity", ArrayType(StructType([StructField("type", StringType()), StructField("score", StringType())]))), StructField("database_specific", StructType([StructField("severity", StringType())])),
])


def advisories(spark: SparkSession, path: str) -> DataFrame:
    """Advisory files as (id, aliases, severity, affected(package, ranges)); malformed files are skipped."""
    rows = spark.read.schema(ADVISORY).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path).where("id IS NOT NULL")
    flat = F.transform("affected", lambda a: F.struct(a["package"]["name"].alias("package"), a["ranges"].alias("ranges")))
    return rows.select("id", "aliases", F.lower("database_specific.severity").alias("severity"), flat.alias("affected"))


def usage_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a usage log; bad lines are skipped."""
    return spark.read.schema("ts timestamp_ntz, repo_id string, query string, n_results long, file_chars long, snippet_chars long").option("mode", "DROPMALFORMED").json(path)


def codeowners(spark: SparkSession, path: str) -> DataFrame:
    """(pattern, owner) of an owners file: comments dropped, the first owner counts."""
    return _owner_lines(spark.read.text(path)).select("pattern", "owner")


def _owner_lines(lines: DataFrame) -> DataFrame:
    v = F.split(F.trim("value"), r"\s+")
    return lines.where(~F.trim("value").startswith("#") & (F.size(v) >= 2)).withColumn("pattern", v[0]).withColumn("owner", v[1])


def repo_owners(files: DataFrame) -> DataFrame:
    """(repo_id, pattern, owner): the rules of each repo's owners file; one in the root comes before one in ``.github``."""
    f = files.where(F.col("file_path").isin("CODEOWNERS", ".github/CODEOWNERS") & (F.coalesce("content", F.lit("")) != ""))
    one = f.groupBy("repo_id").agg(F.max_by("content", F.struct((F.col("file_path") == "CODEOWNERS"), "content")).alias("content"))
    return _owner_lines(one.select("repo_id", F.explode(F.split("content", "\r?\n")).alias("value"))).select("repo_id", "pattern", "owner")
