"""Command line over a chunk store: ``python -m lexivec.cli --dataset DIR COMMAND ...``."""

from __future__ import annotations

import argparse
import hashlib
import os
import sys

from lexivec.operators import rerank as reranking
from lexivec.operators.chunker import chunk_markdown
from lexivec.operators.embed import HashingEmbedder, checked_query, run_embed
from lexivec.operators.ingest import run_index
from lexivec.plans import hybrid, output
from lexivec.schema import DEFAULT_COLLECTION, DEFAULT_TOP_K, ChunkOptions, LexivecError
from lexivec.session import build_session
from lexivec.sources.registry import Registry
from lexivec.sources.store import ChunkStore


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexivec")
    top.add_argument("--dataset", default=os.path.expanduser("~/.lexivec/chunks"))
    top.add_argument("--registry", default=os.path.expanduser("~/.lexivec/registry.toml"))
    top.add_argument("--dim", type=int, default=1024)
    add = top.add_subparsers(dest="command", required=True).add_parser
    p = add("index")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("-c", "--collection", default=DEFAULT_COLLECTION)
    add("embed")
    add("embed-query").add_argument("query")
    for name in ("search", "vsearch", "query"):
        p = add(name)
        p.add_argument("query")
        form = p.add_mutually_exclusive_group()
        form.add_argument("--json", action="store_true")
        form.add_argument("--files", action="store_true")
        p.add_argument("--all", action="store_true")
        p.add_argument("-n", "--top-k", type=int, default=DEFAULT_TOP_K)
        p.add_argument("--min-score", type=float)
        if name == "query":
            p.add_argument("--explain", action="store_true")
            p.add_argument("--rerank", action="store_true")
    p = add("rerank")
    p.add_argument("--query", required=True)
    p.add_argument("--top-k", type=int)
    p.add_argument("--json", action="store_true")
    p.add_argument("--instruction")
    for name in ("inspect", "status", "config", "doctor"):
        add(name)
    p = add("compact")
    p.add_argument("--keep", type=int, default=1)
    p = add("chunk")
    p.add_argument("file")
    p.add_argument("--text", action="store_true")
    p.add_argument("--max-tokens", type=int, default=900)
    p.add_argument("--overlap-tokens", type=int, default=135)
    p = add("get")
    p.add_argument("what")
    p.add_argument("--full", action="store_true")
    add("multi-get").add_argument("what")
    p = add("watch")
    p.add_argument("path")
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--once", action="store_true")
    p = add("collection")
    p.add_argument("action", choices=("add", "list", "remove"))
    p.add_argument("name", nargs="?")
    p.add_argument("root", nargs="?")
    p = add("context")
    p.add_argument("action", choices=("add",))
    p.add_argument("uri")
    p.add_argument("note")
    p = add("verify")
    p.add_argument("file")
    p.add_argument("--sha256")
    return top


def run(args: argparse.Namespace, out=sys.stdout, source=sys.stdin, log=sys.stderr) -> None:
    command = args.command
    if command == "chunk":
        with open(args.file, encoding="utf-8") as f:
            chunks = chunk_markdown(f.read(), ChunkOptions(args.max_tokens, args.overlap_tokens))
        for c in chunks:
            out.write(f"{c.index}\t{c.start_byte}..{c.end_byte}\t{c.token_count} tokens\n" + (c.text + "\n" if args.text else ""))
        return
    if command == "verify":
        out.write(file_sha256(args.file, args.sha256) + "\n")
        return
    if command in ("collection", "context"):
        return _registry(args, out)
    spark = build_session()
    if command == "rerank":
        candidates = reranking.validated(spark, source.read())
        ranked = reranking.rerank(candidates, args.query, None, args.top_k, args.instruction)
        out.write((output.reranked_json if args.json else output.reranked_table)(ranked))
        return
    model = HashingEmbedder(args.dim)
    if command == "index":
        store = ChunkStore.open_or_create(spark, args.dataset, args.dim)
        done = run_index(spark, store, args.path, args.collection)
        out.write(f"indexed {done.files} files, {done.chunks} chunks, {done.skipped} skipped, {done.removed} removed\n")
        return
    store = ChunkStore.open_or_create(spark, args.dataset, args.dim) if command == "inspect" else ChunkStore.open(spark, args.dataset)
    if command == "embed":
        done = run_embed(store, lambda: HashingEmbedder(args.dim))
        out.write(f"embedded {done.rows} rows in {done.batches} batches ({done.model_id}, {done.dim})\n")
    elif command == "embed-query":
        out.write(output.vector_json(checked_query(store, model, args.query)))
    elif command in ("search", "vsearch", "query"):
        _retrieve(args, store, model, out, log)
    elif command == "compact":
        store.compact(keep=args.keep)
    elif command in ("inspect", "status"):
        out.write(output.describe(store))
    elif command == "config":
        out.write("".join(f"{r['key']} = {r['value']}\n" for r in store.config().collect()))
    elif command == "doctor":
        found = store.stats().first()
        out.write("".join(f"{k}: {v}\n" for k, v in found.asDict().items()))
    elif command in ("get", "multi-get"):
        rows = (hybrid.get if command == "get" else hybrid.multi_get)(store, args.what).collect()
        for r in rows:
            out.write(f"{r['path']}#{r['chunk_index']}\n" + (r["text"] + "\n" if command == "multi-get" or args.full else ""))
    elif command == "watch":
        from lexivec.streaming.watch import watch

        watch(spark, store, args.path, args.checkpoint, once=args.once, on_report=lambda r: log.write(f"{r}\n")).awaitTermination()


def _retrieve(args, store, model, out, log) -> None:
    k = max(store.count_rows(), 1) if args.all else args.top_k
    if args.command == "search":
        hits = hybrid.search(store, args.query, k, args.min_score)
    elif args.command == "vsearch":
        hits = hybrid.vsearch(store, model, args.query, k, args.min_score)
    else:
        done = hybrid.query(store, model, args.query, k, args.min_score, reranking.OverlapScorer() if args.rerank else None)
        hits = done.hits
        if args.explain:
            log.write(output.trace(done))
    out.write(output.render(hits, "json" if args.json else "files" if args.files else "table"))


def _registry(args, out) -> None:
    held = Registry.load(args.registry)
    if args.command == "context":
        for c in held.collections:
            if args.uri.startswith(f"lexivec://{c.name}/") or args.uri == f"lexivec://{c.name}":
                c.contexts[args.uri] = args.note
                return held.save(args.registry)
        raise LexivecError(f"no collection holds {args.uri}")
    if args.action == "list":
        out.write("".join(f"{c.name}\t{c.root}\n" for c in held.collections))
        return None
    held.add(args.name, args.root) if args.action == "add" else held.remove(args.name)
    return held.save(args.registry)


def file_sha256(path: str, expected: str | None = None) -> str:
    """The digest of a file in hexadecimal; an expected one is compared without regard to case."""
    with open(path, "rb") as f:
        found = hashlib.file_digest(f, "sha256").hexdigest()
    if expected and found != expected.lower():
        raise LexivecError(f"{path}: SHA-256 is {found}, not {expected}")
    return found


def main(argv: list[str] | None = None) -> int:
    try:
        run(parser().parse_args(argv))
    except (LexivecError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
