"""Source trees: which files count, their language, and symbols, imports, targets and permissions found by patterns.

There is no grammar engine here; the patterns find top-level declarations and import statements of each language, which is what
the graph keeps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders and files that never count.
SKIPPED_DIRS = "node_modules dist build out target coverage vendor third_party _vendor extern generated gen pb proto_gen testdata".split()
SKIPPED_FILES = r"(\.min\.(js|css)|\.map|\.lockb|\.wasm)$|^(package-lock\.json|bun\.lock|yarn\.lock|pnpm-lock\.yaml|\.DS_Store|Thumbs\.db|\.git(ignore|attributes|modules))$"
MOST_BYTES, PROBE = 1_048_576, 4096

# Languages by file name ending.
LANGUAGES = {"ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "go": "go", "py": "python", "rs": "rust", "java": "java", "rb": "ruby", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "cs": "c_sharp", "bzl": "starlark"}
BUILD_FILES = ("BUILD", "BUILD.bazel")

_NAME = r"([A-Za-z_]\w*)"
#: What declares a symbol, and what names an import, in each language.
SYMBOLS = {
    "typescript": rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+|async\s+|declare\s+)*(?:function\*?|class|interface|enum|type|const|let|var)\s+{_NAME}",
    "go": rf"^(?:func\s+(?:\([^)]*\)\s*)?|type\s+|var\s+|const\s+){_NAME}",
    "python": rf"^(?:async\s+)?(?:def|class)\s+{_NAME}",
    "rust": rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?:fn|struct|enum|trait|mod|type|static)\s+{_NAME}",
    "java": rf"^\s*(?:public\s+|protected\s+|private\s+|static\s+|final\s+|abstract\s+|sealed\s+)*(?:class|interface|enum|record|@interface)\s+{_NAME}",
    "ruby": r"^\s*(?:class|module|def)\s+(?:self\.)?([A-Za-z_][\w:]*[?!]?)",
    "c": rf"^(?:static\s+|inline\s+|extern\s+|const\s+)*(?:(?:struct|enum|union)\s+{_NAME}\s*\{{|[A-Za-z_][\w\s*]*?\b{_NAME}\s*\([^;]*$)",
    "cpp": rf"^\s*(?:class|struct|enum(?:\s+class)?|namespace)\s+{_NAME}|^[A-Za-z_][\w:<>\s*&]*?\b{_NAME}\s*\([^;]*$",
    "c_sharp": rf"^\s*(?:public\s+|internal\s+|private\s+|protected\s+|static\s+|sealed\s+|abstract\s+|partial\s+)*(?:class|interface|enum|struct|record|namespace)\s+{_NAME}",
    "starlark": rf"^(?:def\s+{_NAME}|{_NAME}\s*=)",
}
IMPORTS = {
    "typescript": r"""(?:^|\n)\s*(?:import|export)\b[^'"\n;]*?from\s*['"]([^'"]+)['"]|(?:^|\n)\s*import\s*['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]\s*\)""",
    "go": r"""(?:^|\n)\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w./-]+)"\s*(?=\n|$)""",
    "python": r"(?:^|\n)\s*(?:from\s+([.\w]+)\s+import|import\s+([.\w]+))",
    "rust": r"(?:^|\n)\s*(?:pub\s+)?use\s+([\w:]+)",
    "java": r"(?:^|\n)\s*import\s+(?:static\s+)?([\w.]+)",
    "ruby": r"""(?:^|\n)\s*require(?:_relative)?\s*\(?['"]([^'"]+)['"]""",
    "c": r"""(?:^|\n)\s*#\s*include\s*[<"]([^>"]+)[>"]""",
    "c_sharp": r"(?:^|\n)\s*using\s+(?:static\s+)?([\w.]+)\s*;",
    "starlark": r"""load\(\s*['"]([^'"]+)['"]""",
}
for _of, _same in (("tsx", "typescript"),):
    SYMBOLS[_of], IMPORTS[_of] = SYMBOLS[_same], IMPORTS[_same]
IMPORTS["cpp"] = IMPORTS["c"]


def language(path: str) -> str | None:
    base = path.rsplit("/", 1)[-1]
    if base in BUILD_FILES:
        return "starlark"
    if base.split(".")[0] in ("WORKSPACE", "MODULE") and base.endswith((".bazel", "WORKSPACE")):
        return None
    return LANGUAGES.get(base.rsplit(".", 1)[-1].lower()) if "." in base else None


def ignored(path: str, rules: list[str]) -> bool:
    """Ignore-file rules in order, later ones winning: * and ? within a name, ** across, a leading / anchors, a trailing / means folders, ! takes back."""
    out = False
    for rule in rules:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        back = rule.startswith("!")
        rule = rule.lstrip("!")
        folder, anchored = rule.endswith("/"), "/" in rule.rstrip("/")
        body = re.escape(rule.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        pattern = ("^" if anchored else "(?:^|/)") + body + ("/" if folder else "(?:/|$)")
        if re.search(pattern, path):
            out = not back
    return out


def walk(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """(path, content, bytes, content_hash): text files below root that count; sizes are checked before contents are read."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(F.col("length") <= MOST_BYTES)
    rel = F.regexp_replace(F.col("path"), "^.*?" + re.escape(base.split(":")[-1].lstrip("/")), "")
    rows = files.select(rel.alias("path"), F.col("length").alias("bytes"), "content")
    name = F.element_at(F.split("path", "/"), -1)
    dirs = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    rows = rows.filter(~name.rlike(SKIPPED_FILES) & ~F.exists(dirs, lambda d: d.isin(SKIPPED_DIRS) | d.startswith(".")))
    for rule in exclude or []:
        rows = rows.filter(~F.udf(lambda p, r=rule: ignored(p, [r]), "boolean")("path"))
    binary = F.instr(F.hex(F.substring("content", 1, PROBE)), "00") > 0
    zero = F.expr(f"exists(sequence(1, least({PROBE}, length(content))), i -> substring(content, i, 1) = X'00')")
    return rows.filter(~(binary & zero)).select("path", F.decode("content", "UTF-8").alias("content"), "bytes", F.sha2("content", 256).alias("content_hash"))


def extract(path: str, text: str) -> list[tuple[str, str, str]]:
    """(kind, name, detail): symbols, imports, and what build files and controllers say."""
    lang = language(path)
    if not lang:
        return []
    out, seen = [], set()
    for m in re.finditer(SYMBOLS[lang], text, re.M):
        name = next((g for g in m.groups() if g), None)
        if name and name not in seen:  # the first of a name counts
            seen.add(name)
            out.append(("symbol", name, lang))
    for m in re.finditer(IMPORTS[lang], text):
        if spec := next((g for g in m.groups() if g), None):
            out.append(("import", spec, lang))
    if lang == "starlark":
        out += bazel_targets(path, text)
    if lang == "go":
        out += controller_links(text) + rbac_grants(text)
    return out


def bazel_targets(path: str, text: str) -> list[tuple[str, str, str]]:
    """('target', //pkg:name, rule) and ('depends', //pkg:name, dep); a bare :x is of the same package."""
    package, out = path.rsplit("/", 1)[0] if "/" in path else "", []
    for m in re.finditer(r"(?ms)^(\w+)\(\s*\n?(.*?)^\)", text):
        name = re.search(r"""\bname\s*=\s*["']([^"']+)["']""", m[2])
        if not name:
            continue
        label = f"//{package}:{name[1]}"
        out.append(("target", label, m[1]))
        deps = re.search(r"(?s)\bdeps\s*=\s*\[(.*?)\]", m[2])
        for d in re.findall(r"""["']([^"']+)["']""", deps[1]) if deps else []:
            out.append(("depends", label, f"//{package}{d}" if d.startswith(":") else d))
    return out


def controller_links(text: str) -> list[tuple[str, str, str]]:
    """('watches' or 'owns', controller, kind) from SetupWithManager."""
    out = []
    for m in re.finditer(r"(?ms)^func\s+\(\w*\s*\*?(\w+)\)\s+SetupWithManager\b(.*?)^\}", text):
        for call, kind in re.findall(r"\.(For|Owns|Watches)\(\s*&?(?:source\.Kind\{[^}]*?&)?(?:\w+\.)?(\w+)\{", m[2]):
            out.append(("owns" if call == "Owns" else "watches", m[1], kind))
    return out


def rbac_grants(text: str) -> list[tuple[str, str, str]]:
    """('grants', struct, group/resource#verb) from permission markers before a type; several resources, subresources and urls are skipped."""
    out = []
    for m in re.finditer(r"(?m)((?:^//.*\n)+)\s*type\s+(\w+)", text):
        for marker in re.findall(r"\+kubebuilder:rbac:(\S+)", m[1]):
            keys = dict(p.split("=", 1) for p in marker.split(",") if "=" in p)
            group, resource, verbs = keys.get("groups", "").strip('"'), keys.get("resources", ""), keys.get("verbs", "")
            if not resource or not verbs or "urls" in keys or ";" in resource or "/" in resource:
                continue
            out += [("grants", m[2], f"{group or 'core'}/{resource}#{v}") for v in verbs.split(";")]
    return out


FACTS = "path string, kind string, name string, detail string"


def facts(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *f) for p, t in zip(pdf["path"], pdf["content"]) for f in extract(p, t or "")]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "detail"])

    return files.select("path", "content").mapInPandas(run, FACTS)


# What a relative import may stand for, in order.
ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def import_edges(found: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target): relative imports resolved to the first candidate that is a known file."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    joined = F.concat_ws("/", F.expr("nullif(folder, '')"), "name")
    rel = found.filter("kind = 'import' and name like '.%'").withColumn("folder", folder).select("path", joined.alias("p"))
    # ./ and ../ are taken out one level at a time
    rel = rel.withColumn("p", F.regexp_replace("p", r"(^|/)(\./)+", "$1"))
    for _ in range(8):
        rel = rel.withColumn("p", F.regexp_replace("p", r"(^|/)(?!\.\./)[^/]+/\.\./", "$1"))
    cand = rel.select("path", "p", F.posexplode(F.array(*[F.concat("p", F.lit(e)) for e in ENDINGS])).alias("i", "target"))
    hit = cand.join(files.select(F.col("path").alias("target")), "target")
    return hit.groupBy("path", "p").agg(F.min_by("target", "i").alias("target")).select("path", "target").distinct()


def gone(episodes: DataFrame, visited: DataFrame, root: str) -> DataFrame:
    """Active source episodes of the same walk whose path was not visited: to be archived."""
    mine = episodes.filter("status = 'active' and source_type = 'source'").filter(F.get_json_object("metadata", "$.walk_root") == root)
    return mine.withColumn("path", F.split("source_ref", "@")[0]).join(visited.select("path"), "path", "left_anti")
