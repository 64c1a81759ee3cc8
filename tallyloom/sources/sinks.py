"""Sinks: Parquet, row streams, and reports as JSON, Markdown and HTML from small results."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.workbook import write_book


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def stream_rows(df: DataFrame, most: int | None = None, batch: int = 100) -> Iterator[str]:
    """JSON lines: meta, rows in batches, and complete, or limited if there are more rows than asked for. A partition at a
    time reaches the driver."""
    yield json.dumps({"type": "meta", "columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema]})
    held: list = []
    n = 0
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("row"))
    more = False
    for r in (rows if most is None else rows.limit(most + 1)).toLocalIterator():
        if most is not None and n == most:
            more = True
            break
        held.append(json.loads(r["row"]))
        n += 1
        if len(held) == batch:
            yield json.dumps({"type": "data", "rows": held})
            held = []
    if held:
        yield json.dumps({"type": "data", "rows": held})
    yield json.dumps({"type": "limited" if more else "complete", "rows": n})


def collect_small(results: dict[str, DataFrame], most: int = 1000) -> dict[str, list[dict]]:
    """The first rows of each result as plain values: results are summaries, bounded by `most` rows each. A result with
    more rows is followed by one that says so, named after it."""
    out = {}
    for name, df in results.items():
        rows = [json.loads(r["j"]) for r in df.select(F.to_json(F.struct(*df.columns)).alias("j")).limit(most + 1).collect()]
        out[name] = rows[:most]
        if len(rows) > most:
            out[f"{name} (first {most} rows)"] = [{"note": f"{name} has more rows than the {most} above"}]
    return out


def to_json(results: dict[str, DataFrame], most: int = 1000) -> str:
    return json.dumps(collect_small(results, most), ensure_ascii=False, indent=1)


def to_markdown(results: dict[str, DataFrame], title: str = "Report", most: int = 100) -> str:
    out = [f"# {title}"]
    for name, rows in collect_small(results, most).items():
        cols = list(dict.fromkeys(k for r in rows for k in r))
        out += [f"\n## {name}\n", "| " + " | ".join(cols) + " |", "|" + "-|" * len(cols)]
        out += ["| " + " | ".join(str(r.get(c, "")).replace("|", "\\|") for c in cols) + " |" for r in rows]
    return "\n".join(out)


def to_html(results: dict[str, DataFrame], title: str = "Report", most: int = 100) -> str:
    cell = lambda tag, x: f"<{tag}>{html.escape(str(x))}</{tag}>"
    parts = []
    for name, rows in collect_small(results, most).items():
        cols = list(dict.fromkeys(k for r in rows for k in r))
        parts.append(cell("h2", name) + "<table><tr>" + "".join(cell("th", c) for c in cols) + "</tr>" + "".join("<tr>" + "".join(cell("td", r.get(c, "")) for c in cols) + "</tr>" for r in rows) + "</table>")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'>{cell('title', title)}</head><body>{cell('h1', title)}{''.join(parts)}</body></html>"


def to_excel(results: dict[str, DataFrame], path: str, most: int = 10_000) -> None:
    """A sheet a result, of small results; write_workbooks is for large ones."""
    tables = []
    for name, rows in collect_small(results, most).items():
        cols = list(dict.fromkeys(k for r in rows for k in r))
        flat = [[json.dumps(v, ensure_ascii=False) if isinstance(v, list | dict) else v for v in map(r.get, cols)] for r in rows]
        tables.append((name, cols, iter(flat)))
    with open(path, "wb") as f:
        write_book(f, tables)
