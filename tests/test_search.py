import random
import re

from pyspark.sql import functions as F

from pathquarry.functions.derive import derive
from pathquarry.operators import aggregate as A
from pathquarry.operators import search as S
from pathquarry.plans.compile import apply, wildcard_regex
from pathquarry.plans.language import Options
from pathquarry.schema import ENTRY, EPOCH


def frame(spark, rows):
    """rows: (path, size, is_dir, attributes)."""
    full = [(p, s, EPOCH + 10**7 * i, EPOCH + 10**7 * i, EPOCH, d, a, i, "C:") for i, (p, s, d, a) in enumerate(rows)]
    return derive(spark.createDataFrame(full, ENTRY))


def names(df):
    return sorted(r.name for r in df.select("name").collect())


ROWS = [
    (r"C:\p\AGENTS.md", 1 << 20, False, 128), (r"C:\p\demo.gif", 10**6, False, 128), (r"C:\p\readme.md", 2 << 20, False, 0), (r"C:\p\sub", 0, True, 16),
    (r"C:\p\sub\CaseFile.txt", 7, False, 33), (r"C:\p\node_modules\x.js", 5, False, 128), (r"C:\pfoo\café.rs", 9, False, 2), (r"C:\p\.env", 1, False, 2),
    (r"C:\p\a.tar.gz", 3, False, 128), (r"C:\p\no*star", 4, False, 128),
]


def test_known_queries(spark):
    files = frame(spark, ROWS)
    want = {
        "AGENTS.md demo.gif": [], "AGENTS.md | demo.gif": ["AGENTS.md", "demo.gif"], "file: md": ["AGENTS.md", "readme.md"], "readme or:demo": ["demo.gif", "readme.md"],
        "size:1mb": ["AGENTS.md"], "size:>=1mb": ["AGENTS.md", "readme.md"], "case:CaseFile.txt": ["CaseFile.txt"], "case:casefile.txt": [], "case:Case*": ["CaseFile.txt"],
        "caf?.rs": [], "caf??.rs": ["café.rs"], "*.tar.gz": ["a.tar.gz"], "ext:env": [".env"], "attrib:h": [".env", "café.rs"], "attrib:n !md": ["a.tar.gz", "demo.gif", "no*star"],
        r"no\*star": ["no*star"], r"*\**": ["no*star"], "ww:casefile.txt": ["CaseFile.txt"], "len:8": ["a.tar.gz", "café.rs", "demo.gif"], r"C:\p\sub": ["CaseFile.txt", "sub"],
        r"!C:\p": ["café.rs"], "regex:^[a-d].*": ["AGENTS.md", "CaseFile.txt", "a.tar.gz", "café.rs", "demo.gif"], "regex:(": [], "!regex:( folder:": ["sub"], "regex:É": ["café.rs"],
    }
    for text, expect in want.items():
        assert names(apply(files, Options(query=text))) == expect, text
    assert names(apply(files, Options(path="C:/p/"))) == names(apply(files, Options(query=r"C:\p")))
    assert "x.js" in names(apply(files, Options(include_all=True, exclude_path="sub"))) and "sub" not in names(apply(files, Options(exclude_path="SUB")))


def wild(pattern, text, case=False):
    """An independent matcher over bytes: (pattern index, text index) by recursion."""
    p, t = (pattern, text) if case else ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in (pattern, text))
    p, t = p.encode(), t.encode()

    def go(i, j):
        if i == len(p):
            return j == len(t)
        c = p[i : i + 1]
        if c == b"*":
            k = i
            while p[k : k + 1] == b"*":
                k += 1
            return any(go(k, m) for m in range(j, len(t) + 1) if k - i > 1 or b"\\" not in t[j:m])
        if c == b"\\" and p[i + 1 : i + 2] in (b"*", b"?", b"[", b"#", b"\\") and i + 1 < len(p):
            return t[j : j + 1] == p[i + 1 : i + 2] and go(i + 2, j + 1)
        if j == len(t):
            return False
        if c == b"?":
            return t[j : j + 1] != b"\\" and go(i + 1, j + 1)
        if c == b"#":
            return t[j : j + 1].isdigit() and go(i + 1, j + 1)
        return t[j] == p[i] and go(i + 1, j + 1)

    return go(0, 0)


def test_wildcards_against_matcher():
    rng = random.Random(8)
    for _ in range(3000):
        pattern = "".join(rng.choice("ab*?#\\1É.") for _ in range(rng.randrange(7)))
        text = "".join(rng.choice("aAb1\\.É*?") for _ in range(rng.randrange(7)))
        java = wildcard_regex(pattern, False)
        regex = re.sub(r"\\x\{(\w+)\}", lambda m: f"\\x{int(m[1], 16):02x}", java).replace(r"\z", r"\Z")
        assert bool(re.match(regex, text.encode().decode("latin-1"))) == wild(pattern, text), (pattern, text)


def test_classes():
    check = lambda p, t: bool(re.match(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\x{int(m[1], 16):02x}", wildcard_regex(p, False)).replace(r"\z", r"\Z"), t))
    assert check("file[0-9].txt", "file5.txt") and not check("file[0-9].txt", "filex.txt") and check("[z-a]", "M") and check("[]x]", "]") and check("[!a]", "b")
    assert check("[ab", "[ab") and not check("[!a]", "A") and check("[&&]", "&")


def test_pages_and_orders(spark):
    files = frame(spark, ROWS)
    assert [r.name for r in S.find(files, Options(sort="size", max_results=2, offset=1)).collect()] == ["AGENTS.md", "demo.gif"]
    assert [r.extension for r in S.find(files, Options(sort="extension", max_results=3)).collect()] == [None, None, "env"]
    assert S.find(files, Options(max_results=0)).count() == S.count(files, Options()).first()[0] == 9
    assert "TakeOrderedAndProject" in S.find(files, Options(sort="size"))._jdf.queryExecution().toString()


def test_pushdown(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    frame(spark, ROWS).write.parquet(str(tmp_path / "f"))
    plan = apply(spark.read.parquet(str(tmp_path / "f")), Options(query="ext:md,rs size:>1kb dm:>1980-01-01", path="C:/p")).select("path")._jdf.queryExecution().toString()
    for part in ("In(extension", "GreaterThanOrEqual(size", "StringStartsWith(lower_path", "GreaterThanOrEqual(modified"):
        assert part in plan, part


def test_aggregate(spark):
    row = A.aggregate(frame(spark, ROWS), Options(query="file:", include_all=True), 2).first()
    assert (row.total, row.files, row.folders) == (9, 9, 0)
    assert [(x.path, x.size) for x in row.largest] == [(r"C:\p\readme.md", 2 << 20), (r"C:\p\AGENTS.md", 1 << 20)]
    assert [x.extension for x in row.by_extension][:2] == ["md", ""] and sum(x["count"] for x in row.by_extension) == 9
    big = frame(spark, [(f"/{i}", 2**62, False, 0) for i in range(3)])
    assert A.totals(big).first().total_size == 2**63 - 1
    empty = A.aggregate(big.limit(0), Options()).first()
    assert (empty.total, empty.total_size, empty.largest, empty.by_extension) == (0, 0, [], [])
    assert A.nearest_rank(frame(spark, ROWS), "size", 0.5).count() == 1
    assert S.duplicates(big.unionByName(big.withColumn("path", F.concat(F.lit("/x"), "path")))).count() == 6
