import random

from codelattice.llm.handwritten import fingerprints, heading, not_handwritten, verdict

_WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def _code(seed, n=12):
    rnd = random.Random(seed)
    pick = lambda: rnd.choice(_WORDS) + rnd.choice(["", "s", "Set", "Map"])
    body = []
    for _ in range(n):
        a, b, c = pick(), pick(), pick()
        lines = [f"\tif {a} == nil {{\n\t\treturn err{b.title()}\n\t}}", f"\t{a}.{b}Count += {rnd.randrange(90)}", f"\tfor _, {a} := range {b} {{\n\t\t{c}.{pick()}({a})\n\t}}", f"\t// {pick()} goes before the {pick()}, see {c}", f'\tlog.{a.title()}("{b} {c}", {pick()})', f"\tdefer {pick()}.Unlock()"]
        rnd.shuffle(lines)
        body.append(f"func {a}{c.title()}({b} int) error {{\n" + "\n".join(lines[: rnd.randint(2, 6)]) + "\n\treturn nil\n}\n")
    return "\n".join(body)


BODY = _code(1)


def reason(path, content, language="go", external=False):
    return verdict(path, language, content, external, ("Fernwood Parcels",))[0]


def test_marks_and_denials():
    for mark in ("// Code generated by toolx v1. DO NOT EDIT.", "/* @generated by toolx */", "# AUTOGENERATED FILE - run `make x` to refresh it", "/*\n * <auto-generated> t wrote this </auto-generated>\n */"):
        assert reason("a/b.go", mark + "\n\npackage a\n" + BODY) == "generated"
        assert reason("a/b.go", "package a\n\n" + mark + "\n" + BODY) == "generated"
    for mark in ("// Emitted from api.idl with toolx; changes here will be overwritten.", "// Written by the toolx compiler. Edit api.idl and regenerate instead of touching this.", "# This file was made automatically."):
        assert reason("a/b.go", mark + "\n\npackage a\n" + BODY) == "generated"
    for text in ("// Derived from the depot's tables; never change the order of the rows.", "// Keep this list sorted, edit by hand.", "// Output of the planner is checked here. Rerun it after a change.", "// Written by hand from the notes of the parcel team.", "// Run again after a change of the parcel table.", "// Not generated: toolx can't express this, so please edit freely.", "// This file used to be written by toolx; it is kept by hand.", "// Generated clients call into this file. Edit it as usual."):
        assert reason("a/b.go", text + "\npackage a\n" + BODY) is None
    assert reason("a/b.go", "package a\n" + BODY + "\nconst banner = `// Code generated by toolx. DO NOT EDIT.`\n") is None


def test_third_party_by_path_notice_and_hint():
    assert reason("x/vendor/lib/a.go", BODY) == "third-party"
    assert reason("x/vendorportal/a.go", BODY) is None
    assert reason("x/a.go", BODY, external=True) == "third-party"
    assert reason("x/a.go", "// Copyright (c) 2014 the lib authors. Permission to use, copy\n" + BODY) == "third-party"
    assert reason("x/a.go", "// Copyright Fernwood Parcels. Internal source, see NOTICE.\n" + BODY) is None


def test_layout():
    rnd = random.Random(1)
    packed = "".join(f"{rnd.choice('abcdef')}={rnd.choice('xyz')}?{rnd.choice('uvw')}:{rnd.randrange(9)};if(a&&b!==c){{d();return}}" for _ in range(80))
    assert reason("s/a.js", packed, "javascript") == "minified"
    assert reason("s/a.js", "function f(a) {\n  return a + 1;\n}\n" + packed, "javascript") == "minified"
    assert reason("s/a.go", BODY + "\nvar s = `" + "some words in a long line, " * 30 + "`\n") is None
    assert reason("s/a.ts", "export default [\n" + "\n".join(f'  {{"id": {i}, "w": 0.{rnd.randrange(9999)}, "tag": "t{rnd.randrange(99)}"}},' for i in range(80)) + "\n]", "typescript") == "data"
    assert reason("s/a.go", "\n".join(f"{i};name;{rnd.randrange(10**6)};0.{rnd.randrange(999)};x" for i in range(90))) == "data"
    assert reason("s/a.go", BODY + "\nvar t = []int{\n" + "\n".join(f'\t{{"case {i}", {i}}},' for i in range(12)) + "\n}\n") is None
    fields = "\n".join(f"\tField{i} {t}" for i in range(40) for t in ("string",))
    assert reason("s/a.go", "package a\n\ntype M struct {\n" + fields + "\n}\n") == "generated"


def test_copies_and_dirty(spark):
    third = "// Copyright (c) 2014 the lib authors. Permission to use, copy and share\n\npackage lib\n" + BODY
    other = "package a\n" + _code(2)
    rows = [
        ("r1", "main", "lib/a.go", "go", third), ("r2", "main", "util/b.go", None, "package util\n\n" + BODY), ("r2", "dev", "util/b.go", None, "package util\n\n" + BODY),
        ("r3", "main", "own/c.go", "go", other), ("r3", "main", "own/c.go", "go", "﻿" + other.replace("\n", "\r\n")), ("r4", "main", "e.go", "go", ""), ("r4", "main", "n.go", "go", None),
        (None, "main", None, None, None), ("r5", "main", "vendor/v.go", "go", None), ("r6", "main", "long.go", "go", "// " + "x y " * 100_000),
    ]
    schema = "repo_id string, branch string, file_path string, language string, content string"
    found = {(r.repo_id, r.file_path): r.reason for r in not_handwritten(spark.createDataFrame(rows, schema)).collect()}
    assert found == {("r1", "lib/a.go"): "third-party", ("r2", "util/b.go"): "third-party", ("r5", "vendor/v.go"): "third-party"}
    nodes = spark.createDataFrame([("r3", "own/c.go", True, "file"), ("r4", "e.go", None, None)], "repo_id string, file_path string, external boolean, kind string")
    assert ("r3", "own/c.go") in {(r.repo_id, r.file_path) for r in not_handwritten(spark.createDataFrame(rows, schema), nodes).collect()}
    assert not_handwritten(spark.createDataFrame([], schema + ", reason string, body string")).count() == 0


def test_heading_and_fingerprints():
    assert heading("// a\n/* b */\npackage x\n// c\nfunc f() {}")[1].strip().endswith("func f() {}")
    assert fingerprints("") == [] and len(fingerprints("one two")) == 1
    assert set(fingerprints(BODY)) == set(fingerprints(BODY.replace("\n", "\n\n")))


def test_copies_are_decided_on_all_shingles(spark):
    notice = "// Copyright (c) 2014 the lib authors. Permission to use, copy and share\n\n"
    rows, due = [], set()
    for i in range(40):
        rnd = random.Random(100 + i)
        words = ["".join(rnd.choices("abcdefghijklmnopqrst", k=7)) for _ in range(104)]
        for edits in (3, 4, 5):  # 15, 20 and 25 of 100 shingles
            mine = list(words)
            for at in range(edits):
                mine[10 + 20 * at] = "edited"
            rows.append((f"r{i}", f"own/{edits}.txt", "text", "\n".join(mine)))
            if edits <= 4:
                due.add((f"r{i}", f"own/{edits}.txt"))
        rows.append((f"r{i}", "lib.txt", "text", notice + "\n".join(words)))
    short, tiny = "func twice(a int) int { return a + a }", "module.exports = again"
    rows += [("s", "lib.go", "go", notice + short), ("s", "own.go", "go", short), ("s", "no.go", "go", short.replace("twice", "double")), ("s", "lib.js", "javascript", notice + tiny), ("s", "own.js", "javascript", tiny)]
    rows += [("s", "lib/doc.go", "go", notice + "package lib"), ("s", "own/doc.go", "go", "package lib")]
    found = {(r.repo_id, r.file_path) for r in not_handwritten(spark.createDataFrame(rows, "repo_id string, file_path string, language string, content string")).collect()}
    assert {x for x in found if "lib" not in x[1]} == due | {("s", "own.go"), ("s", "own.js")}


def test_dense_and_short_layout():
    rnd = random.Random(4)
    name = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(1, 4)))
    packed = "".join(rnd.choice(["if(%s&&!%s){%s();return}", "%s=%s?%s:null;", "%s(function(%s){%s()});", "for(%s of %s)%s++;", "var %s={%s:[%s]};"]) % (name(), name(), name()) for _ in range(150))
    for width in (72, 120, 250):  # bundles wrapped below the length of a packed line
        wrapped = "\n".join(packed[i : i + width] for i in range(0, len(packed), width))
        assert reason("s/a.js", wrapped, "javascript") == reason("s/a.ts", wrapped, "typescript") == "minified"
    narrow = "\n".join(packed[i : i + 57] for i in range(0, len(packed), 57))  # the thresholds are a language's own
    assert reason("s/a.go", narrow, "go") is None and reason("s/a.js", narrow + "\n" + packed[:60], "javascript") == "minified"
    encoded = "\n".join(f"{i % 10}:" + "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=38)) + "-" + "".join(rnd.choices("abcdefghij", k=38)) + ";x" for i in range(20))
    assert reason("s/a.txt", encoded, "text") == "data"
    # short bodies: data and minified ones are found, plain ones are not
    assert reason("s/a.json", '[\n  {"12": 4.5, "13": 7},\n  {"14": 4.5, "15": 9}\n]', "json") == "data"
    assert reason("s/a.csv", "12;4.5;7;1004\n13;4.5;9;1005\n14;4.1;9;1006", "csv") == "data"
    assert reason("s/a.js", packed[:150], "javascript") == "minified"
    for text in ("package version\n\nconst Build = 20240101123456\n", 'export { default } from "./src/components/parcels/tracking/index";\n', "module.exports=require('./lib/index.js');", "package a\n\nvar t = []int{1, 2, 3, 4, 5}\n"):
        assert reason("s/a.ts", text, "typescript") is None
    assert reason("s/a.go", BODY + '\nvar s = "' + "".join(rnd.choices("ABCDEFGHIJKLMNOPabcdefghijklmnop", k=len(BODY))) + '"\n') is None  # a long line among code


def test_idioms_of_many_packages_make_no_copy(spark):
    rnd = random.Random(6)
    words = lambda n: " ".join("".join(rnd.choices("abcdefghijklmnopqrst", k=7)) for _ in range(n))
    idioms = [words(30) for _ in range(8)]
    rows = [(f"r{i}", f"vendor/pack{i}/a.go", "go", words(40) + "\n" + idiom) for i, idiom in enumerate(idioms)]
    own, version = "\n".join(idioms), rows[0][3].replace("a", "b", 1)
    rows += [("own", "a/idioms.go", "go", own), ("own", "a/copy.go", "go", rows[3][3]), ("r9", "vendor/pack0/v2.go", "go", version)]
    found = {(r.repo_id, r.file_path) for r in not_handwritten(spark.createDataFrame(rows, "repo_id string, file_path string, language string, content string")).collect()}
    assert ("own", "a/copy.go") in found and ("own", "a/idioms.go") not in found


def test_owners_are_the_callers():
    text = "// Copyright Acme Ltd. All rights reserved.\n" + BODY
    assert verdict("x/a.go", "go", text, False)[0] == "third-party" and verdict("x/a.go", "go", text, False, ("acme ltd",))[0] is None
