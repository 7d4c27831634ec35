"""Names across files: what an import stands for after all re-exports, and which imported functions return request data.

One pass over the files gives three small tables (imports, re-exports, exported functions); relative
modules are matched with files by path; then every import follows its re-exports by joins, one hop a
round, until none is left or HOPS are done.  A module's own names come before what it takes over whole.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesieve.functions import vocabulary as V
from lodesieve.sources.code import Unit, re_exports
from lodesieve.sources.scratch import Scratch

TABLE = pa.schema([("file", pa.string()), ("kind", pa.string()), ("local", pa.string()), ("module", pa.string()), ("base", pa.string()), ("name", pa.string()), ("taints", pa.bool_())])


def base(file: str, module: str) -> str | None:
    """The path that a relative module names, without its suffix; None for a package."""
    return posixpath.normpath(posixpath.join(posixpath.dirname(file), module)) if module[:1] in (".", "/") else None


def exported_functions(u: Unit) -> dict[str, bool]:
    """Names of a file's exported functions, and whether they return request data by themselves."""
    out: dict[str, bool] = {}
    returned: dict[int, bool] = {}
    for n in u.nodes.get("return", ()):
        f = u.function(n)
        if f is not None and n.value:
            returned[f.start] = returned.get(f.start, False) or u.has_source(n.value)
    for f in u.functions:
        lead = u.clean[max(0, f.start - 400) : f.start]
        own = u.clean[f.start : f.body[0]]
        taints = u.has_source(f.body) if f.bare else returned.get(f.start, False)
        if f.kind == "declaration" and own.startswith("export"):
            if f.name:
                out[f.name] = taints
            if re.match(r"export\s+default\b", own):
                out["default"] = taints
        elif f.kind in ("arrow", "expression"):
            m = re.search(r"\bexport\s+(?:(default)|(?:const|let|var)\s+([\w$]+)\s*(?::[^=]*)?=)\s*$", lead)
            if m or re.match(r"export\s+default\b", own):
                out[m[2] if m and m[2] else "default"] = taints
    return out


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u = Unit(file, content)
            if not u.s.whole:
                continue
            for local, (module, name) in u.imports.items():
                b = base(file, module)
                if b is None:
                    continue
                rows.append((file, "import", local, module, b, name, False))
                used = {n.name for n in u.nodes.get("call", ()) if u.receiver(n) == local}
                rows += [(file, "import", f"{local}.{x}", module, b, x, False) for x in sorted(used)]
            rows += [(file, "re_export", here, module, base(file, module), there, False) for here, module, there in re_exports(u.clean)]
            rows += [(file, "export", name, None, None, name, taints) for name, taints in exported_functions(u).items()]
        yield pa.RecordBatch.from_pylist([dict(zip(TABLE.names, r, strict=True)) for r in rows], schema=TABLE)


def tables(files: DataFrame) -> DataFrame:
    """file, kind, local, module, base, name, taints: imports of relative modules, re-exports and exported functions."""
    rows = files.select("file", "content").where("content is not null and content <> ''")
    return rows.mapInArrow(_tables, "file string, kind string, local string, module string, base string, name string, taints boolean")


def located(bases: DataFrame, files: DataFrame) -> DataFrame:
    """base, target: the file that a base names, by the first suffix that fits.  A base without one has no row."""
    tried = bases.where("base is not null").select("base").distinct().select("base", F.posexplode(F.array(*[F.concat("base", F.lit(x)) for x in V.MODULE_SUFFIXES])).alias("k", "target"))
    return tried.join(files.select(F.col("file").alias("target")).distinct(), "target").groupBy("base").agg(F.min_by("target", "k").alias("target"))


def resolved(files: DataFrame) -> DataFrame:
    """file, local, module, name, taints: what each import of a relative module stands for in the end.

    Imports whose file is missing, or whose name it doesn't have, end where they are; so do circles of
    re-exports after HOPS.  Repeated files count as one; an empty table gives no rows.  Every
    hop is written to the shared folder, so plans stay small and a lost executor costs one hop.
    """
    scratch = Scratch(files.sparkSession, "symbols")
    held = scratch.save(tables(files).distinct(), "tables")
    where = scratch.save(located(held, files), "located")
    passed = held.where("kind = 're_export'").join(where, "base", "left").select(F.col("file").alias("at"), F.col("local").alias("wanted"), F.col("module").alias("to_module"), F.col("name").alias("to_name"), F.col("target").alias("to_target"))
    named = passed.where("wanted <> '*'").groupBy("at", "wanted").agg(F.min(F.struct("to_module", "to_name", "to_target")).alias("by_name"))
    whole = passed.where("wanted = '*'").groupBy("at").agg(F.min(F.struct("to_module", "to_target")).alias("by_all"))
    own = held.where("kind = 'export'").groupBy(F.col("file").alias("at"), F.col("local").alias("wanted")).agg(F.max("taints").alias("own_taints"))
    state = held.where("kind = 'import'").join(where, "base", "left").select("file", "local", "module", "name", "target")
    done = None
    for hop in range(V.HOPS):
        step = state.withColumnsRenamed({"target": "at", "name": "wanted"}).join(named, ["at", "wanted"], "left").join(own, ["at", "wanted"], "left").join(whole, "at", "left")
        step = scratch.save(step, f"hop-{hop}")
        moves = F.col("at").isNotNull() & (F.col("by_name").isNotNull() | F.col("own_taints").isNull() & F.col("by_all").isNotNull())
        ended = step.where(~moves).select("file", "local", "module", F.col("wanted").alias("name"), F.coalesce("own_taints", F.lit(False)).alias("taints"))
        done = ended if done is None else done.unionByName(ended)
        moved = step.where(moves)
        state = moved.select("file", "local", F.coalesce("by_name.to_module", "by_all.to_module").alias("module"), F.coalesce("by_name.to_name", "wanted").alias("name"), F.when(F.col("by_name").isNotNull(), F.col("by_name.to_target")).otherwise(F.col("by_all.to_target")).alias("target"))
        if moved.isEmpty():
            return done
    return done.unionByName(state.select("file", "local", "module", "name", F.lit(False).alias("taints")))


def dangerous(symbols: DataFrame) -> DataFrame:
    """Those that matter to the detectors: dangerous built-ins, and functions that return request data."""
    builtin = F.lit(False)
    for module, names in V.BUILTINS.items():
        builtin = builtin | F.col("module").isin(module, f"node:{module}") & F.col("name").isin(*sorted(names))
    return symbols.where(F.col("taints") | builtin)
