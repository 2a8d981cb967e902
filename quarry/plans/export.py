"""The read-only search tool: its schema for several callers, answers to their calls, and adapters."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.augment import markdown
from quarry.plans.pipeline import Pipeline

ABOUT = "Find passages of the knowledge base for a query: ranked, numbered blocks, each with its [Source: ...] and score."


def tool_schema() -> dict:
    properties = {
        "query": {"type": "string", "description": "What to look for."},
        "top_k": {"type": "integer", "default": 5, "minimum": 1, "maximum": 50, "description": "How many passages, 5 if not said."},
        "filter": {"type": "object", "description": 'Which metadata passages must have: {field: value} or {field: {"$gte": value}}, "$in" and so on.'},
    }
    return {"name": "search", "description": ABOUT, "input_schema": {"type": "object", "properties": properties, "required": ["query"]}}


#: Where each caller's protocol wants the tool's parts.
FORMS = {
    "canonical": {"name": "name", "description": "description", "input_schema": "input_schema"},
    "mcp": {"name": "name", "description": "description", "inputSchema": "input_schema"},
    "openai": {"type": "=function", "function": {"name": "name", "description": "description", "parameters": "input_schema"}},
    "anthropic": {"name": "name", "description": "description", "input_schema": "input_schema"},
}


def rendered(form: str) -> dict:
    """The tool's schema in one of FORMS; "=..." stands for itself, other strings for the part they name."""
    parts = tool_schema()

    def fill(shape):
        if isinstance(shape, dict):
            return {k: fill(v) for k, v in shape.items()}
        return shape[1:] if shape.startswith("=") else parts[shape]

    return fill(FORMS[form])


def search(spark: SparkSession, pipeline: Pipeline, query: str, top_k: int = 5, where: dict | None = None, with_method: bool = False) -> str:
    """One query's passages as numbered blocks."""
    rows = search_rows(spark, pipeline, query, top_k, where)
    found = markdown(rows, with_method).collect()
    if found:
        return found[0].text
    return "No passages found for that query." if with_method else "No passages found."


def search_rows(spark: SparkSession, pipeline: Pipeline, query: str, top_k: int = 5, where: dict | None = None) -> DataFrame:
    return pipeline.retrieve(spark.createDataFrame([(0, query)], "qid long, query string"), min(max(int(top_k), 1), 50), where)


def openai_arguments(call) -> dict:
    """Arguments of a function call given as an object or a mapping, themselves a mapping or JSON."""
    function = call["function"] if isinstance(call, dict) else call.function
    raw = function["arguments"] if isinstance(function, dict) else function.arguments
    return json.loads(raw) if isinstance(raw, str) else dict(raw or {})


def anthropic_arguments(block) -> dict:
    return dict((block.get("input") if isinstance(block, dict) else block.input) or {})


def answer_call(spark: SparkSession, pipeline: Pipeline, arguments: dict) -> str:
    return search(spark, pipeline, arguments["query"], arguments.get("top_k", 5), arguments.get("filter"))


def langchain_documents(spark: SparkSession, pipeline: Pipeline, query: str, top_k: int = 5) -> list:
    from langchain_core.documents import Document

    rows = search_rows(spark, pipeline, query, top_k).orderBy("rank").collect()
    return [Document(page_content=r.content, metadata={"source": r.source, "doc_id": r.doc_id, "score": r.score, "method": r.retrieval_method}) for r in rows]


def llamaindex_nodes(spark: SparkSession, pipeline: Pipeline, query: str, top_k: int = 5) -> list:
    from llama_index.core.schema import NodeWithScore, TextNode

    rows = search_rows(spark, pipeline, query, top_k).orderBy("rank").collect()
    return [NodeWithScore(node=TextNode(id_=r.doc_id, text=r.content), score=r.score) for r in rows]


def serve(spark: SparkSession, pipeline: Pipeline, name: str = "quarry") -> None:
    """A server with the one tool over standard input and output; its errors are answers."""
    from mcp.server.fastmcp import FastMCP

    server = FastMCP(name)

    @server.tool(name="search", description=ABOUT)
    def tool(query: str, top_k: int = 5, filter: dict | None = None) -> str:
        try:
            return search(spark, pipeline, query, top_k, filter, with_method=True)
        except Exception as e:
            return f"Search failed: {e}"

    server.run()
