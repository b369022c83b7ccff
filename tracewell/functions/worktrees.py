"""Names that tools give to working copies, read off a path's segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Layout:
    """Where a tool keeps its working copies: below marker, mostly with child as the next segment.

    repo and label say which segment names the repository and the copy: a number counts
    from the marker (1 is the segment behind it, -1 the one before), last is the path's
    last segment. label_from counts from the first such segment instead.
    """

    tool: str
    marker: str
    child: str | None
    repo: int | str
    label: int | str | None
    label_from: str | None = None


# Folders of the tools, in the order in which they are tried.
LAYOUTS = (
    Layout("cursor", ".cursor", "worktrees", 2, None),
    Layout("vibe-kanban", "vibe-kanban", "worktrees", "last", 1, "worktrees"),
    Layout("conductor", "conductor", "workspaces", 2, 2, "workspaces"),
    Layout("auto-claude", ".auto-claude", "worktrees", -1, 1, "tasks"),
    Layout("21st", ".21st", "worktrees", -1, "bracket"),
    Layout("claude-desktop", ".claude-worktrees", None, 1, 2),
    Layout("ccswitch", ".ccswitch", "worktrees", 2, 2, "worktrees"),
)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _at(parts: Column, place: Column, step: int) -> Column:
    """The segment step places from the one at place (1 is the first, 0 none); null without either."""
    index = place + (step - 1)
    return F.when((place > 0) & (index >= 0), F.get(parts, index.cast("int")))


def _last(parts: Column) -> Column:
    return F.try_element_at(parts, F.lit(-1))


def repository_name(path: Column) -> Column:
    """The repository that a path belongs to, also of a copy that is gone: as its tool's layout says, else the last segment; null without segments."""
    parts = segments(path)
    found = []
    for one in LAYOUTS:
        place = F.array_position(parts, one.marker)
        fits = place > 0
        if one.child:
            fits = fits & _at(parts, place, 1).eqNullSafe(F.lit(one.child))
        found.append(F.when(fits, _last(parts) if one.repo == "last" else _at(parts, place, one.repo)))
    return F.coalesce(*found, _last(parts))


def worktree_tool(path: Column) -> Column:
    """The tool that made a working copy, by the segments that occur anywhere in its path; git otherwise."""
    parts = segments(path)
    has = lambda s: F.coalesce(F.array_contains(parts, s), F.lit(False))
    known = [F.when(has(one.marker) & (has(one.child) if one.child else F.lit(True)), one.tool) for one in LAYOUTS if one.label is not None]
    return F.coalesce(*known, F.lit("git"))


def is_worktree_path(path: Column) -> Column:
    """Whether a path alone shows a working copy; one of conductor only if it lies below its repository's folder."""
    parts = segments(path)
    has = lambda s: F.coalesce(F.array_contains(parts, s), F.lit(False))
    out = F.lit(False)
    for one in LAYOUTS:
        fits = has(one.marker) & (has(one.child) if one.child else F.lit(True))
        if one.tool == "conductor":
            fits = fits & (F.size(parts) > F.array_position(parts, one.marker) + 2)
        out = out | fits
    return out


def worktree_label(path: Column, branch: Column, is_main: Column, git_name: Column | None = None) -> Column:
    """What a working copy is called: by its tool's layout; a main copy of git by its branch, others by git's own name, the branch or the last segment."""
    parts, tool = segments(path), worktree_tool(path)
    last = _last(parts)
    own = git_name if git_name is not None else F.lit(None).cast("string")
    out = F.when(tool == "git", F.when(is_main, F.coalesce(branch, F.lit("main"))).otherwise(F.coalesce(own, branch, last)))
    for one in LAYOUTS:
        if one.label is None:
            continue
        if one.label == "bracket":
            inside = F.regexp_extract(last, r"^[^\[]*\[([^\]]+)\]", 1)
            label = F.when(F.length(inside) > 0, inside).otherwise(last)
        else:
            place = F.array_position(parts, one.label_from or one.marker)
            if one.label_from and one.tool == "ccswitch":  # the first one behind the marker
                marker = F.array_position(parts, one.marker)
                behind = F.array_position(F.slice(parts, F.greatest(marker, F.lit(1)).cast("int"), F.size(parts)), one.label_from)
                place = F.when(behind > 0, behind + marker - 1).otherwise(0)
            label = _at(parts, place, one.label)
            if one.tool == "auto-claude":
                label = F.coalesce(label, last)
        out = out.when(tool == one.tool, label)
    return F.coalesce(out, branch, last, F.lit("unknown"))
