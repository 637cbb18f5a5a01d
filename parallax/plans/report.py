"""Markdown reports of audits and validations. Rows come to the driver: a report is as small as its reader."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame


def table(rows: DataFrame, limit: int | None = None) -> str:
    """A Markdown table of all rows, or of the first ones."""
    return lines(rows.columns, (rows if limit is None else rows.limit(limit)).collect())


def lines(columns: list[str], rows: list) -> str:
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def audit(results: DataFrame, samples: dict[str, DataFrame] | None = None) -> str:
    """Counts, then errors, warnings and what passed; five sample rows of a failed check where given."""
    rows = sorted(results.collect(), key=lambda r: r["name"])
    groups = {
        "Errors": [r for r in rows if not r["passed"] and r["severity"] == "error"],
        "Warnings": [r for r in rows if not r["passed"] and r["severity"] != "error"],
        "Passed": [r for r in rows if r["passed"]],
    }
    out = ["# Data audit", "", f"{len(rows)} checks: " + ", ".join(f"{len(v)} {k.lower()}" for k, v in groups.items()), ""]
    for title, own in groups.items():
        if own:
            out += [f"## {title}", ""]
            for r in own:
                out.append(f"- **{r['name']}**: {r['message']}")
                if samples and not r["passed"] and r["name"] in samples:
                    out += ["", table(samples[r["name"]], 5), ""]
            out.append("")
    return "\n".join(out)


def validation(side: str, fits: DataFrame, scores: DataFrame, cases: DataFrame) -> str:
    """Fits, scorecard and each held-out player's predictions."""
    out = [f"# Validation: {side}", "", "## Fits", "", table(fits), "", "## Out of sample", "", table(scores), ""]
    columns = ["stat", "kbo_relative", "predicted", "p10", "p90", "actual", "in_interval"]
    held_out = cases.select("player", *columns).orderBy("player", "stat").collect()  # a row for each held-out player and statistic
    for player, own in groupby(held_out, key=lambda r: r["player"]):
        out += [f"## {player}", "", lines(columns, [r[1:] for r in own]), ""]
    return "\n".join(out)
