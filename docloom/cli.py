"""Command line: parse, normalize, translate, run, resume, config check. Exit codes: 0 done, 1 failed, 2 no input, 3 not configured."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from docloom.deploy import ship
from docloom.functions.retry import Patience
from docloom.plans.jobs import Job
from docloom.sources import config as settings
from docloom.sources.config import Config
from docloom.sources.services import ChatTranslator, DocumentParser, Http, ImageHost, MockTranslator


def _http(part: settings.Section) -> Http:
    return Http(part.connect_timeout, part.read_timeout, part.write_timeout)


def _chat(c: Config) -> ChatTranslator:
    t = c.translator
    return ChatTranslator(_http(t), t.base_url, t.api_key, t.model, t.temperature, t.top_p, Patience(c.translation.max_retries, c.translation.backoff_base, c.translation.request_interval))


def _parser(c: Config) -> DocumentParser:
    p = c.parser
    options = {"enable_formula": p.enable_formula, "language": p.language, "enable_table": True, "model_version": p.model_version}
    return DocumentParser(_http(p), p.base_url.rstrip("/"), p.token, options, p.poll_interval, p.poll_timeout)


#: What makes services for a configuration, by name; a deployment adds its own. Beside each, the section that must be configured.
PARSERS: dict[str, tuple[Callable, str]] = {"remote": (_parser, "parser")}
TRANSLATORS: dict[str, tuple[Callable, str]] = {"chat": (_chat, "translator"), "mock": (lambda c: MockTranslator(), "")}
HOSTS: dict[str, tuple[Callable, str]] = {"remote": (lambda c: ImageHost(Http(), c.image_host.base_url, c.image_host.token), "image_host")}

HELP = {
    "parse": "source files through the parser to Markdown", "normalize": "Markdown to normalised blocks and Markdown", "translate": "Markdown to translated Markdown",
    "run": "parse, then translate", "resume": "translate what has no result yet, of sources that haven't changed",
}


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="docloom", description="Parse, normalise and translate documents on Spark.")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, text in HELP.items():
        sub.add_parser(name, help=text).add_argument("input", help="a file, a folder or a pattern")
    sub.add_parser("config", help="settings").add_subparsers(dest="config_command", required=True).add_parser("check", help="show what is configured")
    parser.add_argument("--work-dir", help="where results are kept for resuming")
    parser.add_argument("--out-dir", help="where parsed documents are written")
    parser.add_argument("--category", default="", help="first level of the folders of documents and uploads; guessed by default")
    parser.add_argument("--sub-category", default="", help="second level of these folders")
    parser.add_argument("--upload-images", action="store_true", help="upload images and refer to their URLs")
    for name, known, default in (("parser", PARSERS, "remote"), ("translator", TRANSLATORS, "chat"), ("host", HOSTS, "remote")):
        parser.add_argument(f"--{name}", default=default, help=f"one of: {', '.join(known)}")
    parser.add_argument("--version", action="version", version="%(prog)s 0.2.0")
    return parser


def config_check() -> int:
    c = settings.load()
    print(f"config dir: {c.config_dir or '(none)'}")
    for name, part, secret in (("parser", c.parser, c.parser.token), ("translator", c.translator, c.translator.api_key), ("image host", c.image_host, c.image_host.token)):
        print(f"{name}: {'configured' if part.configured else 'not configured'}  {settings.masked(secret)}")
    print(f"translator model: {c.translator.model or '(none)'}; image upload: {'on' if c.image_host.enabled else 'off'}")
    return 0


def show(event: str, data: dict) -> None:
    """An event as a line."""
    print(f"[{event.lower().replace('_', ' ')}] {', '.join(f'{k} {v}' for k, v in data.items())}".rstrip(), flush=True)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = build_parser().parse_args(argv)
    if args.command == "config":
        return config_check()
    given = args.input.rstrip("/")
    if "://" not in given and not (Path(given).exists() or any(Path(given).parent.glob(Path(given).name))):
        print(f"no such file: {given}", file=sys.stderr)
        return 2
    config = settings.load()
    config.image_host.category, config.image_host.sub_category = args.category, args.sub_category
    config.image_host.enabled = config.image_host.enabled or args.upload_images
    needs = [("parser", PARSERS)] * (args.command in ("parse", "run")) + [("translator", TRANSLATORS)] * (args.command in ("translate", "run", "resume")) + [("host", HOSTS)] * config.image_host.enabled
    for name, known in needs:
        make, section = known.get(getattr(args, name), (None, ""))
        if make is None or section and not getattr(config, section).configured:
            print(f"not configured: {name} {getattr(args, name)}", file=sys.stderr)
            return 3
    given = given if "://" in given else str(Path(given).absolute())
    beside = str(Path(given).parent) if "://" not in given else given.rsplit("/", 1)[0]
    work, out = args.work_dir or f"{beside}/.docloom/{Path(given).stem.replace('*', '_')}", args.out_dir or f"{beside}/outfile"
    work, out = (x if "://" in x else str(Path(x).absolute()) for x in (work, out))
    own = spark is None
    spark = spark or SparkSession.builder.appName("docloom").config("spark.speculation", "false").getOrCreate()
    try:
        ship(spark)
        bound = {name: (lambda make=known[getattr(args, name)][0]: make(config)) for name, known in needs}
        job = Job(spark, config, work, out, bound.get("parser"), bound.get("translator"), bound.get("host"), config.translator.model or args.translator, show)
        if args.command in ("parse", "run"):
            getattr(job, args.command)(given)
        else:
            getattr(job, args.command)(job.read(given))
        return 0
    except Exception as e:  # noqa: BLE001
        print(f"failed: {str(e)[:500]}", file=sys.stderr)
        return 1
    finally:
        if own:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())
