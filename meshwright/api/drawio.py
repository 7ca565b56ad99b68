"""A laid-out slice as draw.io XML."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, functions as F

from ..operators.layout import BOX_HEIGHT, layout

#: Fill colour by kind of node.
FILL = {
    "module": "#f5f5f5", "function": "#dae8fc", "class": "#d5e8d4", "service": "#ffe6cc", "datastore": "#e1d5e7", "queue": "#fff2cc",
    "gateway": "#f8cecc", "route": "#f8cecc", "job": "#ffe6cc", "config": "#eeeeee",
}


def render(nodes: DataFrame, edges: DataFrame) -> str:
    """XML of nodes (id, kind, subtype, file, line, name) and edges (src, dst, relation, file, line).

    Parallel edges are drawn once with all their places; edges that are no calls are dashed.
    """
    at = {r.id: r for r in layout(nodes.select("id"), edges.select("src", "dst")).collect()}
    cells = []
    for i, n in enumerate(sorted(nodes.collect(), key=lambda r: r.id)):
        box, title = at[n.id], f"{n.name or n.id}\n{n.subtype or n.kind}"
        tip = f"{n.id} ({n.file}:{n.line})"
        style = f"rounded=1;whiteSpace=wrap;html=1;fillColor={FILL.get(n.kind, '#ffffff')};"
        cells.append(
            f'<UserObject id="n{i}" label={quoteattr(title)} tooltip={quoteattr(tip)}><mxCell style="{style}" vertex="1" parent="1">'
            f'<mxGeometry x="{box.x}" y="{box.y}" width="{box.width}" height="{BOX_HEIGHT}" as="geometry"/></mxCell></UserObject>'
        )
    number = {n.id: f"n{i}" for i, n in enumerate(sorted(nodes.select("id").collect()))}
    site = F.concat_ws(":", "file", F.col("line").cast("string"))
    merged = edges.groupBy("src", "dst", "relation").agg(F.array_join(F.sort_array(F.collect_set(site)), ", ").alias("sites"))
    for i, e in enumerate(merged.orderBy("src", "dst", "relation").collect()):
        dashed = "" if e.relation == "calls" else "dashed=1;"
        cells.append(
            f'<UserObject id="e{i}" label={quoteattr(e.relation)} tooltip={quoteattr(e.sites)}><mxCell style="edgeStyle=orthogonalEdgeStyle;html=1;{dashed}" '
            f'edge="1" parent="1" source="{number[e.src]}" target="{number[e.dst]}"><mxGeometry relative="1" as="geometry"/></mxCell></UserObject>'
        )
    body = "\n".join(cells)
    return f'<mxfile><diagram name="slice"><mxGraphModel><root><mxCell id="0"/><mxCell id="1" parent="0"/>\n{body}\n</root></mxGraphModel></diagram></mxfile>\n'
