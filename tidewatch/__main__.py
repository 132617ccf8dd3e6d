"""``python -m tidewatch ROUTE FOLDER [key=value ...]``: run a read route over a folder of tables and print its rows.

``python -m tidewatch config FILE`` validates a configuration."""

import sys
from datetime import datetime, timezone
from pathlib import Path


def main(args: list[str]) -> int:
    if args[:1] == ["config"] and len(args) == 2:
        from tidewatch.plans.config import load, violations

        wrong = violations(load(Path(args[1]).read_text()))
        print("\n".join(wrong) or "valid")
        return int(bool(wrong))
    from tidewatch.plans.api import ROUTES

    if len(args) < 2 or args[0] not in ROUTES:
        print(f"{__doc__}\nRoutes: {', '.join(ROUTES)}")
        return 2
    from tidewatch.plans import adapters
    from tidewatch.session import build_session
    from tidewatch.tables import table

    spark, folder = build_session(), args[1]
    p = dict(x.split("=", 1) for x in args[2:])
    as_of = datetime.fromisoformat(p.pop("as_of", datetime.now(timezone.utc).isoformat()))
    tables = {n: table(spark, folder, n) for n in ("raw_content", "ioc_sightings", "sources", "entities", "edges")}
    for n in ("iocs", "correlations", "vulnerabilities", "notes"):
        tables[n] = getattr(adapters, n)(spark, folder)
    ROUTES[args[0]](tables, p, as_of).show(int(p.get("limit", 50)), truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
