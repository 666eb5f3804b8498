"""Paths of the tree: the absolute path is the key, everything else is derived."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent_path(path: Column) -> Column:
    """The path without its last segment, null at the root."""
    p = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(p != "", p)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 2


def project_slug(path: Column) -> Column:
    """The project's name of /projects/<name>/...; null elsewhere."""
    return F.when(path.startswith("/projects/") & (F.split_part(path, F.lit("/"), F.lit(3)) != ""), F.split_part(path, F.lit("/"), F.lit(3)))


def link_project(path: Column) -> Column:
    """Third segment of a path of more than three parts, as links compare projects; else null."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 3, F.element_at(parts, 3))


def branch(path: Column) -> Column:
    """/projects/<name>, or / and the first segment."""
    return F.when(path.rlike("^/projects/[^/]+"), F.concat(F.lit("/projects/"), F.split_part(path, F.lit("/"), F.lit(3)))).otherwise(F.concat(F.lit("/"), F.split_part(path, F.lit("/"), F.lit(2))))


def ancestors(path: Column) -> Column:
    """All proper ancestors, the nearest last."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def in_subtree(path: Column, root: str) -> Column:
    """The root itself or below it. The prefix is exact: no character of it is a pattern."""
    return F.lit(True) if root in ("", "/") else (path == root) | path.startswith(root.rstrip("/") + "/")


def pinnable(path: Column) -> Column:
    """At least three segments, none empty, the first of them `projects`."""
    parts = F.split(path, "/")
    return F.coalesce(path.startswith("/projects/") & (F.size(parts) >= 4) & F.forall(F.slice(parts, 2, 1000), lambda x: x != ""), F.lit(False))


def incoming_path(prefix: str, path: Column) -> Column:
    """The path below a prefix; null unless it is absolute, without empty, `.` and `..` segments."""
    parts = F.slice(F.split(path, "/"), 2, 100000)
    ok = path.startswith("/") & F.forall(parts, lambda x: (x != "") & (x != ".") & (x != ".."))
    return F.when(ok, F.concat(F.lit(prefix), path))
