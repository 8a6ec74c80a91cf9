"""python -m tessera STORE COMMAND: sync DIR | sync-stix FILE [--name N] | query SQL | status."""

from __future__ import annotations

import argparse
import datetime as dt
import json


def main(arguments: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("store", help="folder of the store")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, what, more in (("sync", "directory", "a markdown bundle"), ("sync-stix", "file", "a STIX bundle"), ("query", "sql", "SQL over {table} names"), ("status", None, "")):
        p = commands.add_parser(name, help=more)
        if what:
            p.add_argument(what)
        if name == "sync-stix":
            p.add_argument("--name")
    args = parser.parse_args(arguments)

    from tessera.plans import bundle_sync
    from tessera.session import session, ship
    from tessera.sources import bundle, stix
    from tessera.store import Store

    spark = spark or session()
    store, now = Store(ship(spark), args.store), dt.datetime.now(dt.UTC).replace(tzinfo=None)
    if args.command == "sync":
        name, description = bundle.manifest(spark, args.directory)
        print(json.dumps(bundle_sync.sync_bundle(store, bundle.read_bundle(spark, args.directory), name, args.directory, now, description)))
    elif args.command == "sync-stix":
        name = args.name or args.file.rstrip("/").rpartition("/")[2].removesuffix(".json")
        print(json.dumps(bundle_sync.sync_stix(store, stix.objects(spark, args.file), name, args.file, now)))
    else:
        rows = bundle_sync.status(store) if args.command == "status" else bundle_sync.query(store, args.sql)
        for line in rows.toJSON().toLocalIterator():
            print(line)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
