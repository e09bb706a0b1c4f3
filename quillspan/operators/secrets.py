"""Secrets in source files: lines that hold one and files that are known to. The value is never told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What such secrets look like, and where they are not looked for.
PATTERNS = {"GOOGLE_API_KEY": "AIza[0-9A-Za-z_-]{35}", "OAUTH_ACCESS_TOKEN": r"ya29\.[0-9A-Za-z_-]+", "SERVICE_ACCOUNT_PRIVATE_KEY": r'"private_key":[\s\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"-----BEGIN'}
#: Folders of builds and caches; a tool that keeps its own folder in projects adds its name to `skip`.
SKIP_DIRS = ["node_modules", "dist", ".git", "lib-cache", "coverage"]
SKIP_EXTS = ["png", "jpg", "jpeg", "gif", "webp", "ico", "pdf", "zip", "gz", "tgz", "tar", "lock", "map", "woff", "woff2", "ttf", "eot"]


def _parts(file: str) -> Column:
    return F.split(F.regexp_replace(file, r"\\", "/"), "/")


def secret_lines(files: DataFrame, skip: list[str] | None = None, patterns: dict[str, str] | None = None) -> DataFrame:
    """(file, line, pattern) of lines that hold a secret, from files (file, content): texts of any size, without build folders and binaries.

    file is relative to the project: folders above it don't count. patterns, by
    name, are looked for beside the known ones. A file that holds none of them is not cut into lines.
    """
    known = PATTERNS | (patterns or {})
    name, found = F.element_at(_parts("file"), -1), F.array(*[F.when(F.col("_l").rlike(rx), F.lit(k)) for k, rx in known.items()])
    seen = ~F.arrays_overlap(_parts("file"), F.array(*map(F.lit, SKIP_DIRS + (skip or [])))) & ~F.lower(name).rlike(rf"\.({'|'.join(SKIP_EXTS)})$") & ~F.col("content").contains("\0")
    some = F.col("content").rlike("|".join(f"(?:{rx})" for rx in known.values()))
    lines = files.where(seen & some).select("file", F.posexplode(F.split("content", "\r?\n", -1)).alias("_at", "_l"))
    return lines.select("file", (F.col("_at") + 1).cast("long").alias("line"), F.explode(F.array_compact(found)).alias("pattern"))


def secret_files(files: DataFrame, skip: list[str] | None = None, look_into: list[str] | None = None) -> DataFrame:
    """(file) that by its name holds secrets, outside of build folders and of hidden ones that look_into doesn't name; contents are not read."""
    parts = _parts("file")
    name, folders = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    hidden = F.exists(folders, lambda x: (x.startswith(".") & ~x.isin(look_into or [])) | x.isin(SKIP_DIRS + (skip or [])))
    return files.where((name.isin(".clasprc.json", ".env") | name.startswith(".env.")) & ~hidden).select("file").distinct()
