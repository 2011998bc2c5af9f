"""Reports as text, HTML and SVG, from single rows of scores and from the small tables of ``operators.charts``."""

from __future__ import annotations

import html
import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Row

WIDTH, HEIGHT, PAD = 640, 320, 36


def _dict(row: Row | Mapping) -> dict:
    return row.asDict() if isinstance(row, Row) else dict(row)


def _value(x: object) -> str:
    return "–" if x is None else ("yes" if x else "no") if isinstance(x, bool) else f"{x:.4f}" if isinstance(x, float) else str(x)


# ---------------------------------------------------------------- text
def score(row: Row | Mapping) -> float:
    """One number from 0 to 1 of a budget audit (the mean of integrity and of one less confusion) or a menu audit (its efficiency)."""
    r = _dict(row)
    return float(r["efficiency"]) if "efficiency" in r else (float(r["integrity"]) + 1.0 - min(1.0, float(r["confusion"]))) / 2


def text(row: Row | Mapping, title: str = "Report") -> str:
    """A title and a line for each value, aligned."""
    r = _dict(row)
    wide = max((len(k) for k in r), default=0)
    return "\n".join([title, "=" * len(title), *(f"{k.replace('_', ' '):<{wide}}  {_value(v)}" for k, v in r.items())])


def advice(row: Row | Mapping) -> str:
    """What an audit's integrity says."""
    r = _dict(row)
    level = float(r.get("integrity", r.get("efficiency", 0.0)))
    if level >= 0.95 and (r.get("is_garp") or r.get("is_sarp")):
        return "Choices agree with one preference; the signal is clean."
    if level >= 0.85:
        return "Minor contradictions; the signal is good, with some noise."
    if level >= 0.7:
        return "Moderate contradictions; look at the single violations."
    return "Many contradictions; this may be several people, a script, or chance."


def audit_text(row: Row | Mapping) -> str:
    """The report of one row of an audit of budgets or menus."""
    return "\n".join([text(row, "Audit"), "", f"score  {score(row):.4f}", advice(row)])


# ---------------------------------------------------------------- HTML
def result_html(row: Row | Mapping, title: str = "Result") -> str:
    """A table of one row's names and values; a first value of yes or no colours the title."""
    r = _dict(row)
    verdict = next((v for v in r.values() if isinstance(v, bool)), None)
    colour = {True: "#1a7f37", False: "#b42318", None: "#444"}[verdict]
    cells = "".join(f"<tr><th>{html.escape(k.replace('_', ' '))}</th><td>{html.escape(_value(v))}</td></tr>" for k, v in r.items())
    return f'<div class="concordia"><h3 style="color:{colour}">{html.escape(title)}</h3><table>{cells}</table></div>'


def table_html(rows: Iterable[Row | Mapping], title: str = "Results") -> str:
    """A table of several rows of the same columns."""
    found = [_dict(r) for r in rows]
    names = list(dict.fromkeys(k for r in found for k in r))
    head = "".join(f"<th>{html.escape(n.replace('_', ' '))}</th>" for n in names)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(_value(r.get(n)))}</td>" for n in names) + "</tr>" for r in found)
    return f'<div class="concordia"><h3>{html.escape(title)}</h3><table><tr>{head}</tr>{body}</table></div>'


def summary_html(tests: Mapping[str, bool], measures: Mapping[str, float], title: str = "Summary") -> str:
    """Tests with a mark and measures with a bar."""
    marks = "".join(f"<li>{'✓' if fine else '✗'} {html.escape(name)}</li>" for name, fine in tests.items())
    bars = "".join(f'<li>{html.escape(name)} <span style="display:inline-block;background:#8ab;height:.7em;width:{max(0.0, min(1.0, value)) * 120:.0f}px"></span> {value:.4f}</li>' for name, value in measures.items())
    return f'<div class="concordia"><h3>{html.escape(title)}</h3><ul>{marks}</ul><ul>{bars}</ul></div>'


# ---------------------------------------------------------------- SVG
def _svg(body: str, title: str) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" font-family="sans-serif" font-size="11"><text x="{PAD}" y="20">{html.escape(title)}</text>{body}</svg>'


def _scale(values: Sequence[float], low: float, high: float) -> list[float]:
    least, most = min(values, default=0.0), max(values, default=1.0)
    return [low + (v - least) / ((most - least) or 1.0) * (high - low) for v in values]


def bars_svg(rows: Iterable[Row | Mapping], x: str, y: str, title: str = "") -> str:
    """A bar for each row."""
    found = sorted((_dict(r) for r in rows), key=lambda r: r[x])
    step = (WIDTH - 2 * PAD) / max(1, len(found))
    top = max((float(r[y]) for r in found), default=1.0) or 1.0
    body = "".join(
        f'<rect x="{PAD + k * step:.1f}" y="{HEIGHT - PAD - float(r[y]) / top * (HEIGHT - 2 * PAD):.1f}" width="{step * 0.9:.1f}" height="{float(r[y]) / top * (HEIGHT - 2 * PAD):.1f}" fill="#48a"><title>{html.escape(_value(r[x]))}: {html.escape(_value(r[y]))}</title></rect>'
        for k, r in enumerate(found)
    )
    return _svg(body, title)


def line_svg(rows: Iterable[Row | Mapping], x: str, y: str, title: str = "") -> str:
    """A line through the rows in order of x."""
    found = sorted(((float(_dict(r)[x]), float(_dict(r)[y])) for r in rows))
    across, up = _scale([a for a, _ in found], PAD, WIDTH - PAD), _scale([b for _, b in found], HEIGHT - PAD, PAD)
    points = " ".join(f"{a:.1f},{b:.1f}" for a, b in zip(across, up, strict=True))
    return _svg(f'<polyline points="{points}" fill="none" stroke="#48a" stroke-width="2"/>', title)


def heat_svg(rows: Iterable[Row | Mapping], x: str, y: str, value: str, title: str = "") -> str:
    """A square for each row, darker for larger values."""
    found = [_dict(r) for r in rows]
    across, up = (sorted({r[c] for r in found}) for c in (x, y))
    side = min((WIDTH - 2 * PAD) / max(1, len(across)), (HEIGHT - 2 * PAD) / max(1, len(up)))
    top = max((float(r[value] or 0) for r in found), default=1.0) or 1.0
    body = "".join(f'<rect x="{PAD + across.index(r[x]) * side:.1f}" y="{PAD + up.index(r[y]) * side:.1f}" width="{side:.1f}" height="{side:.1f}" fill="#048" fill-opacity="{float(r[value] or 0) / top:.3f}"/>' for r in found)
    return _svg(body, title)


def ranges_svg(rows: Iterable[Row | Mapping], name: str, low: str, high: str, title: str = "") -> str:
    """A line from low to high (0 to 1) for each row."""
    found = sorted((_dict(r) for r in rows), key=lambda r: r[name])
    step = (HEIGHT - 2 * PAD) / max(1, len(found))
    at = lambda v: PAD + float(v) * (WIDTH - 2 * PAD)
    body = "".join(f'<line x1="{at(r[low]):.1f}" x2="{at(r[high]):.1f}" y1="{PAD + (k + 0.5) * step:.1f}" y2="{PAD + (k + 0.5) * step:.1f}" stroke="#48a" stroke-width="4"/><text x="4" y="{PAD + (k + 0.7) * step:.1f}">{html.escape(_value(r[name]))}</text>' for k, r in enumerate(found))
    return _svg(body, title)


def budgets_svg(rows: Iterable[Row | Mapping], title: str = "") -> str:
    """Budget lines and bundles of ``charts.budget_lines`` for one user."""
    found = [_dict(r) for r in rows]
    wide, tall = (max((float(r[c]) for r in found), default=1.0) or 1.0 for c in ("most_first", "most_second"))
    x = lambda v: PAD + float(v) / wide * (WIDTH - 2 * PAD)
    y = lambda v: HEIGHT - PAD - float(v) / tall * (HEIGHT - 2 * PAD)
    body = "".join(f'<line x1="{x(0):.1f}" y1="{y(r["most_second"]):.1f}" x2="{x(r["most_first"]):.1f}" y2="{y(0):.1f}" stroke="#9bc"/><circle cx="{x(r["first"]):.1f}" cy="{y(r["second"]):.1f}" r="3" fill="#b42318"/>' for r in found)
    return _svg(body, title)


def graph_svg(nodes: Sequence[int], links: Sequence[tuple[int, int]], title: str = "") -> str:
    """Observations on a circle, with their relations."""
    import math

    place = {n: (WIDTH / 2 + 120 * math.cos(2 * math.pi * k / max(1, len(nodes))), HEIGHT / 2 + 120 * math.sin(2 * math.pi * k / max(1, len(nodes)))) for k, n in enumerate(nodes)}
    lines = "".join(f'<line x1="{place[a][0]:.1f}" y1="{place[a][1]:.1f}" x2="{place[b][0]:.1f}" y2="{place[b][1]:.1f}" stroke="#9bc"/>' for a, b in links)
    dots = "".join(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="8" fill="#48a"/><text x="{x - 3:.1f}" y="{y + 4:.1f}" fill="#fff">{n}</text>' for n, (x, y) in place.items())
    return _svg(lines + dots, title)


def graph_dict(graph: str | Mapping) -> dict[str, list]:
    """Nodes, links and violations of a graph written by ``structure.graph_json``: the node-link form that graph libraries read."""
    found = json.loads(graph) if isinstance(graph, str) else dict(graph)
    return {"directed": True, "multigraph": False, "nodes": [{"id": n} for n in found["nodes"]], "links": found["links"]}


def small(rows: DataFrame, most: int = 10_000) -> list[Row]:
    """All rows of a table that is small enough for a picture."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows for one picture")
    return found
