"""Source code: structure and calls of Python files, and questions about them.

Files are parsed in ``mapInPandas``: Python by the standard library's parser, languages with braces by a scanner of
scopes, others by what ``register`` was given.
"""

from __future__ import annotations

import ast
import builtins
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical, language_of, module_name
from ..model import CODE_TYPES, conform, identity
from ..snapshot import Snapshot
from ..sources.files import git_commits, git_files
from . import braces
from . import graph as G

# --- fixed values: names of methods of built-in types that calls to are no news --------------------------
STDLIB_METHODS = (
    "append extend items keys values get pop split join strip lstrip rstrip replace format encode decode lower upper startswith endswith read write readline readlines close open seek"
    " execute fetchone fetchall executemany commit rollback add remove discard update copy clear sort reverse index count insert"
    " __init__ __str__ __repr__ __eq__ __hash__ __len__ __iter__ __next__ __enter__ __exit__ __call__ __getitem__ __setitem__ __contains__ __bool__"
    " now today utcnow fromisoformat isoformat astimezone Path exists is_file is_dir mkdir unlink rglob"
).split()
# ----------------------------------------------------------------------------------------------------------
BUILTINS = sorted({n.lower() for n in (*dir(builtins), *STDLIB_METHODS)})
ENTITIES = "commit string, path string, language string, type string, name string, line_start int, line_end int, signature string, docstring string, visibility string"
LINKS = "commit string, path string, source string, target string, relation string, line int"


def parse_python(source: str, module: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(entities, links, calls) of a file; names are Class.method for methods. Definitions inside functions are
    part of the function; decorated ones count like others."""
    entities: list[tuple] = []
    links: list[tuple] = []
    calls: list[tuple] = []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return [("module", module, 1, source.count("\n") + 1, None, None, "public")], [], []
    hidden = lambda n: "private" if n.startswith("_") else "public"
    entities.append(("module", module, 1, max(1, source.count("\n") + 1), None, ast.get_docstring(tree), "public"))

    def callee(node: ast.expr, owner: str | None) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            if owner and isinstance(node.value, ast.Name) and node.value.id in ("self", "cls"):
                return f"{owner}.{node.attr}"
            return node.attr
        return None

    def function(node, owner: str | None) -> None:
        name = f"{owner}.{node.name}" if owner else node.name
        returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        entities.append(("method" if owner else "function", name, node.lineno, node.end_lineno, f"({ast.unparse(node.args)}){returns}", ast.get_docstring(node), hidden(node.name)))
        links.append((owner or module, name, "DEFINES", node.lineno))
        for x in ast.walk(ast.Module(body=node.body, type_ignores=[])):
            if isinstance(x, ast.Call) and (called := callee(x.func, owner)):
                calls.append((name, called, "CALLS", x.lineno))

    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function(node, None)
        elif isinstance(node, ast.ClassDef):
            entities.append(("class", node.name, node.lineno, node.end_lineno, None, ast.get_docstring(node), hidden(node.name)))
            links.append((module, node.name, "DEFINES", node.lineno))
            for base in node.bases:
                if b := callee(base, None):
                    links.append((node.name, b, "INHERITS_FROM", node.lineno))
            for inner in node.body:
                if isinstance(inner, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    function(inner, node.name)
        elif isinstance(node, ast.Import):
            links += [(module, a.name, "IMPORTS", node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            links.append((module, "." * node.level + (node.module or ""), "IMPORTS", node.lineno))
    return entities, links, calls


Parser = Callable[[str, str], tuple[list[tuple], list[tuple], list[tuple]]]
PARSERS: dict[str, Parser] = {"python": parse_python} | {k: partial(braces.parse, language=k) for k in ("typescript", "javascript", "go", "rust", "java", "php")}


def register(language: str, parser: Parser) -> None:
    """Files of ``language`` are parsed by ``parser(source, module)``, which gives what ``parse_python`` gives."""
    PARSERS[language] = parser


def extract(source: str, language: str, module: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(entities, links, calls) of one file."""
    if language not in PARSERS:
        raise ValueError(f"unsupported language: {language}")
    return PARSERS[language](source, module)


def prepared(files: DataFrame) -> DataFrame:
    """Files (path, content; commit may lack) with language and module name; an unknown language is left out."""
    if "commit" not in files.columns:
        files = files.withColumn("commit", F.lit(None).cast("string"))
    files = files.withColumn("language", language_of(F.col("path")))
    return files.withColumn("module", module_name(F.col("path"), F.col("language"))).where("language is not null").select("commit", "path", "language", "module", "content")


def extract_entities(files: DataFrame) -> DataFrame:
    """Modules, classes, functions and methods of the files; a null content is an empty file."""
    parsers = dict(PARSERS)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for x in part.itertuples(index=False):
                out += [(x.commit, x.path, x.language, *e) for e in parsers[x.language](x.content or "", x.module)[0]]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ENTITIES.split(", ")])

    return prepared(files).mapInPandas(run, ENTITIES)


def extract_links(files: DataFrame) -> DataFrame:
    """Structure (DEFINES, INHERITS_FROM, IMPORTS) and calls, by name."""
    parsers = dict(PARSERS)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for x in part.itertuples(index=False):
                _, links, calls = parsers[x.language](x.content or "", x.module)
                out += [(x.commit, x.path, *e) for e in links + calls]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LINKS.split(", ")])

    return prepared(files).mapInPandas(run, LINKS)


def resolve_calls(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """Calls (path, commit, source, target, line) with target_id and how it was found.

    By falling priority: the same file; the only Class.method that ends so; a function or method of any file; any
    entity of the name. Calls of built-ins that nothing defines are dropped; others stay, with no target.
    """
    current = entities.where("valid_until is null")
    named = current.select(F.coalesce("code_file", F.lit("")).alias("file"), F.coalesce("code_commit_sha", F.lit("")).alias("sha"), "canonical_name", "type", "id", "created_at")
    one = lambda df, *keys: df.groupBy(*keys).agg(F.min_by("id", F.struct("created_at", "id")).alias("found"))
    c = calls.withColumns({"name": F.lower("target"), "sha": F.coalesce("commit", F.lit("")), "file": F.coalesce("path", F.lit(""))})
    own = one(named.where("file <> ''"), "file", "canonical_name").withColumnsRenamed({"found": "by_file", "canonical_name": "name"})
    ends = named.where(F.col("type").isin("method", "function") & (F.col("file") != "") & F.col("canonical_name").contains("."))
    ends = ends.groupBy("sha", F.substring_index("canonical_name", ".", -1).alias("name")).agg(F.min("id").alias("by_suffix"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    bare = one(named.where(F.col("type").isin("method", "function") & (F.col("file") != "")), "sha", "canonical_name").withColumnsRenamed({"found": "by_name", "canonical_name": "name"})
    any_ = one(named, "sha", "canonical_name").withColumnsRenamed({"found": "by_any", "canonical_name": "name"})
    out = c.join(own, ["file", "name"], "left").join(ends, ["sha", "name"], "left").join(bare, ["sha", "name"], "left").join(any_, ["sha", "name"], "left")
    ways = ("by_file", "by_suffix", "by_name", "by_any")
    out = out.withColumns({"target_id": F.coalesce(*ways), "how": F.coalesce(*(F.when(F.col(w).isNotNull(), w) for w in ways))})
    return out.where(F.col("target_id").isNotNull() | ~F.col("name").isin(*BUILTINS)).select("path", "commit", "source", "target", "line", "target_id", "how")


def ingest(tables: dict[str, DataFrame], files: DataFrame, now: str) -> dict[str, DataFrame]:
    """The tables with a set of files: entities, structure and calls. What has no target gets a stub.

    Calls are one edge for each source, target, file and line, so that scanning again adds none.
    """
    from .dml import new_entities, new_sources

    t = F.lit(now).cast("timestamp_ntz")
    files = files if "commit" in files.columns else files.withColumn("commit", F.lit(None).cast("string"))
    content = files.withColumn("content", F.concat("path", F.lit("@"), F.coalesce("commit", F.lit("")), F.lit("\n\n"), "content"))
    sources = tables["sources"].unionByName(new_sources(tables["sources"], content.select("content"), now))
    ref = content.select("path", F.coalesce("commit", F.lit("")).alias("sha"), identity(F.lit("source"), F.sha2("content", 256)).alias("source_ref"))
    found = extract_entities(files)
    attrs = F.to_json(F.struct("signature", "docstring", "visibility", "line_start", "line_end"))
    drafts = found.select("name", "type", F.col("path").alias("code_file"), F.col("language").alias("code_language"), F.col("commit").alias("code_commit_sha"), attrs.alias("attrs_json"))
    entities = tables["entities"].unionByName(new_entities(tables["entities"], drafts, now))
    links = extract_links(files)
    resolved = resolve_calls(links, entities)
    named = links.select("path", F.coalesce("commit", F.lit("")).alias("sha"), "source", "target", "line", "relation").distinct()
    hit = resolved.select("path", F.coalesce("commit", F.lit("")).alias("sha"), "source", "target", "line", "target_id", F.lit(True).alias("_kept")).distinct()
    both = named.join(hit, ["path", "sha", "source", "target", "line"], "left").where(F.col("_kept") | (F.col("relation") != "CALLS"))
    stub = F.when(F.col("relation") == "IMPORTS", "module").when(F.col("relation") == "INHERITS_FROM", "class").otherwise("function")
    stubs = both.where("target_id is null").select(F.col("target").alias("name"), stub.alias("type"), F.lit('{"stub":true}').alias("attrs_json")).distinct()
    entities = entities.unionByName(new_entities(entities, stubs, now))
    at = entities.where("valid_until is null")
    loose = at.where("code_file is null").select("canonical_name", F.col("type").alias("kind"), F.col("id").alias("stub_id"))
    both = both.withColumns({"kind": stub, "canonical_name": canonical(F.col("target"))}).join(loose, ["canonical_name", "kind"], "left")
    callers = at.where("code_file is not null").select(F.col("code_file").alias("path"), F.coalesce("code_commit_sha", F.lit("")).alias("sha"), F.col("canonical_name").alias("_source"), F.col("id").alias("source_id"))
    callers = callers.dropDuplicates(["path", "sha", "_source"])
    both = both.withColumn("_source", canonical(F.col("source"))).join(callers, ["path", "sha", "_source"]).join(ref, ["path", "sha"])
    target = F.coalesce("target_id", "stub_id")
    known = F.col("target_id").isNotNull()
    new = both.select(
        identity(F.lit("edge"), F.col("source_id"), F.col("relation"), target, F.col("source_ref"), F.col("line")).alias("id"), "source_id", target.alias("target_id"), F.col("relation").alias("relation_type"), "source_ref",
        F.when(known, 1.0).otherwise(0.5).alias("confidence_score"), F.when(known, "source_grounded").otherwise("inferred").alias("confidence_class"), t.alias("valid_from"), t.alias("learned_at"), t.alias("detected_at"), F.lit(False).alias("cross_scope"), F.to_json(F.struct("line")).alias("attrs_json"),
    ).dropDuplicates(["id"]).join(tables["edges"].select("id"), "id", "left_anti")
    return dict(tables) | {"sources": sources, "entities": entities, "edges": tables["edges"].unionByName(conform(new, "edges"))}


def _named(g: Snapshot, name: str, file: str | None) -> DataFrame:
    """The entity of a name: in the file if it is given and there, else the oldest one anywhere."""
    hits = g.nodes().where((F.col("canonical_name") == canonical(F.lit(name))) & F.col("type").isin(*CODE_TYPES))
    near = F.coalesce(F.col("code_file") == file, F.lit(False)) if file else F.lit(False)
    return hits.orderBy(F.desc(near), "created_at", "id").limit(1).select("id")


def callers(g: Snapshot, name: str, *, file: str | None = None, limit: int = 10, rounds: int = 30) -> DataFrame:
    """(id, name, score): who calls it, by PageRank from it."""
    target = _named(g, name, file).first()
    if target is None:
        return g.entities.sparkSession.createDataFrame([], "id string, name string, score double")
    inbound = g.links().where((F.col("relation_type") == "CALLS") & (F.col("target_id") == target.id)).select(F.col("source_id").alias("id")).distinct()
    scores = G.pagerank(g, [target.id], rounds=rounds)
    out = g.nodes().select("id", "name").join(inbound, "id", "left_semi").join(scores, "id", "left")
    return out.select("id", "name", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def callees(g: Snapshot, name: str, *, file: str | None = None, limit: int = 50) -> DataFrame:
    """(id, name, confidence_score): what it calls, surest first."""
    source = _named(g, name, file)
    out = g.links().where(F.col("relation_type") == "CALLS").join(source.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    out = out.groupBy(F.col("target_id").alias("id")).agg(F.max("confidence_score").alias("confidence_score"))
    return g.nodes().select("id", "name").join(out, "id").orderBy(F.desc("confidence_score"), "id").limit(limit)


def impact(g: Snapshot, name: str, *, file: str | None = None, limit: int = 20, rounds: int = 30) -> DataFrame:
    """(id, type, name, score): code entities that rank highest around it."""
    seed = _named(g, name, file).first()
    if seed is None:
        return g.entities.sparkSession.createDataFrame([], "id string, type string, name string, score double")
    nodes = g.nodes().where(F.col("type").isin(*CODE_TYPES)).select("id", "type", "name")
    ranked = G.pagerank(g, [seed.id], rounds=rounds).where(F.col("id") != seed.id)
    return nodes.join(ranked, "id").withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "id").limit(limit)


def defined_in(g: Snapshot, path: str) -> DataFrame:
    return g.nodes().where((F.col("code_file") == path) & F.col("type").isin(*CODE_TYPES)).orderBy("type", "name", "id")


def diff(entities: DataFrame, old: str, new: str, file: str | None = None) -> DataFrame:
    """(change, canonical_name): names added, removed, or changed in attributes between two commits."""
    rows = entities.where(F.col("type").isin("function", "class", "method"))
    if file is not None:
        rows = rows.where(F.col("code_file") == file)
    side = lambda sha: rows.where(F.col("code_commit_sha") == sha).groupBy("canonical_name").agg(F.max(F.sha2("attrs_json", 256)).alias("h"))
    a, b = side(old), side(new)
    added = b.join(a, "canonical_name", "left_anti").select(F.lit("added").alias("change"), "canonical_name")
    gone = a.join(b, "canonical_name", "left_anti").select(F.lit("removed").alias("change"), "canonical_name")
    changed = a.join(b.withColumnRenamed("h", "h2"), "canonical_name").where("h <> h2").select(F.lit("changed").alias("change"), "canonical_name")
    return added.unionAll(gone).unionAll(changed)



def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, content, change) of files (path, content) that were added or changed, and the paths that went."""
    a = before.select("path", F.sha2("content", 256).alias("_h"))
    new = now.join(a, "path", "left").where(F.col("_h").isNull() | (F.col("_h") != F.sha2("content", 256)))
    new = new.select("path", "content", F.when(F.col("_h").isNull(), "added").otherwise("changed").alias("change"))
    return new.unionAll(before.join(now.select("path"), "path", "left_anti").select("path", F.lit(None).cast("string"), F.lit("removed")))


def scan(tables: dict[str, DataFrame], before: DataFrame, now: DataFrame, when: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, what changed): entities of files that changed or went are closed, those that came are read."""
    changes = changed_files(before, now)
    stale = changes.where("change <> 'added'").select(F.col("path").alias("_p"))
    t = F.lit(when).cast("timestamp_ntz")
    e = tables["entities"].join(stale, tables["entities"].code_file == stale["_p"], "left")
    closed = e.withColumn("valid_until", F.when(F.col("_p").isNotNull(), F.coalesce("valid_until", t)).otherwise(F.col("valid_until"))).select(tables["entities"].columns)
    files = changes.where("change <> 'removed'").select("path", "content")
    return ingest(dict(tables) | {"entities": closed}, files, when), changes


def ingest_history(tables: dict[str, DataFrame], repo: str, now: str, *, mode: str = "snapshot", paths: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The tables with a git repository's files: of the newest commit (``snapshot``) or of every one (``full``).

    All commits are taken in one pass; a file's entities are kept for each commit, as ``diff`` asks for. Taking them
    again adds none.
    """
    if mode not in ("snapshot", "full"):
        raise ValueError(f"mode is snapshot or full, not {mode}")
    spark = tables["entities"].sparkSession
    commits = git_commits(repo, 1 if mode == "snapshot" else None)
    return ingest(tables, git_files(spark, repo, commits, paths), now)
