"""python -m quern STORE status | ingest FOLDER | ask QUESTION | reset: exit code 0 ok, 2 partly, 1 error."""

from __future__ import annotations

import json
import sys

from quern.api import Engine
from quern.session import local_session


def main(args: list[str]) -> int:
    if len(args) < 2 or args[1] not in ("status", "ingest", "ask", "reset"):
        print(__doc__, file=sys.stderr)
        return 1
    engine = Engine(local_session("*"), args[0])
    try:
        if args[1] == "status":
            result: dict = engine.status()
        elif args[1] == "ingest":
            result = engine.ingest_documents(args[2])
        elif args[1] == "ask":
            result = engine.chat(" ".join(args[2:]))
        else:
            engine.reset("RESET")
            result = {"status": "success"}
    except Exception as error:
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return 1
    print(json.dumps(result, default=str, ensure_ascii=False, indent=1))
    return 2 if result.get("errors") else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
