"""The engine over HTTP, one question at a time."""

from __future__ import annotations

import hmac
import json
import threading
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from gristmill.ask.planner import Answer
from gristmill.engine import Engine, as_html
from gristmill.plans.ir import PlanError
from gristmill.sources.files import Audit, HouseRules, read_scores, report_payload

BODY = 1 << 20


class Service:
    """What the server answers, apart from HTTP."""

    def __init__(self, engine: Engine, audit: Audit, rules: HouseRules | None = None, token: str = "", scores: str = ""):
        self.engine, self.audit, self.rules, self.token, self.scores = engine, audit, rules, token, scores
        self.lock = threading.Lock()
        if rules is not None:
            engine.conversation.rules = rules

    def limited(self, work: Callable[[], tuple[int, object]]) -> tuple[int, object]:
        """What ``work`` gives within the engine's time limit."""
        with self.engine.limit() as limit:
            try:
                return work()
            except Exception:
                if not limit.expired:
                    raise
                return 503, {"error": f"stopped after {self.engine.seconds:g} seconds"}

    def get(self, path: str) -> tuple[int, object]:
        return self.limited(lambda: self._get(path))

    def _get(self, path: str) -> tuple[int, object]:
        if path in ("/", "/health"):
            return 200, {"ok": True}
        if path == "/status":
            return 200, report_payload(self.engine.reports()["inventory"]()) if self.engine.catalog.tables else {"columns": [], "rows": []}
        if path == "/charts":
            return 200, [{**{k: v for k, v in c.items() if k != "data"}, **report_payload(c["data"])} for c in self.engine.charts()]
        if path == "/reports":
            return 200, sorted(self.engine.reports())
        if path == "/rules":
            return 200, {"rules": self.rules.rules() if self.rules else []}
        if path == "/warnings":
            return 200, self.engine.warnings[-50:]
        if path == "/audit":
            return 200, self.audit.recent()
        if path == "/scoreboard":
            return 200, read_scores(self.scores)
        return 404, {"error": "no such path"}

    def post(self, path: str, body: dict) -> tuple[int, object]:
        if path == "/ask":
            with self.lock:
                return self.ask(str(body.get("question", "")))
        if path == "/report":
            return self.limited(lambda: self._report(str(body.get("id", ""))))
        if path == "/rules" and self.rules:
            with open(self.rules.path, "w", encoding="utf-8") as file:
                file.write(str(body.get("text", ""))[: self.rules.most])
            return 200, {"rules": self.rules.rules()}
        if path == "/clear_history":
            self.engine.conversation.clear()
            return 200, {"ok": True}
        return 404, {"error": "no such path"}

    def _report(self, name: str) -> tuple[int, object]:
        make = self.engine.reports().get(name)
        df = make() if make else None
        return (200, report_payload(df)) if df is not None else (404, {"error": "no such report"})

    def ask(self, question: str) -> tuple[int, object]:
        """The answer to a question and then its rows, each within the time limit."""
        began = time.time()
        answer = self.engine.ask(question)
        code, out = self.limited(lambda: (200, self._shown(answer)))
        self.audit.log(question, answer.kind, time.time() - began, out.get("sources", ()))
        return code, out

    def _shown(self, answer: Answer) -> dict:
        out = {"type": answer.kind, "text": answer.text, "options": answer.options or [], "tool": answer.tier, "hint": answer.hint, "seconds": answer.seconds}
        if answer.chart is not None:
            out["chart"] = {k: v for k, v in answer.chart.items() if k != "data"} | report_payload(answer.chart["data"])
        if answer.docs is not None:
            out |= {"confidence": answer.confidence, "documents": report_payload(answer.docs.select("source", "location", "chunk", "score"))}
        if answer.compiled is not None:
            out |= {"table_html": as_html(answer.compiled.df), "provenance": answer.compiled.explain, "sources": answer.compiled.tables_used, "notes": answer.compiled.notes}
        return out


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def reply(self, code: int, payload: object) -> None:
            data = json.dumps(payload, ensure_ascii=False, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def allowed(self) -> bool:
            given = self.headers.get("Authorization", "").removeprefix("Bearer ")
            return not service.token or hmac.compare_digest(given, service.token)

        def run(self, work) -> None:
            if not self.allowed():
                return self.reply(401, {"error": "not authorised"})
            try:
                self.reply(*work())
            except (PlanError, ValueError) as e:
                self.reply(400, {"error": str(e)})
            return None

        def do_GET(self) -> None:  # noqa: N802
            self.run(lambda: service.get(self.path.split("?")[0]))

        def do_POST(self) -> None:  # noqa: N802
            size = int(self.headers.get("Content-Length", 0))
            if size > BODY:
                return self.reply(413, {"error": "too large"})
            body = json.loads(self.rfile.read(size) or b"{}")
            return self.run(lambda: service.post(self.path, body if isinstance(body, dict) else {}))

        def log_message(self, *_) -> None:
            pass

    return Handler


def serve(engine: Engine, audit: Audit, port: int, host: str = "127.0.0.1", token: str = "", rules: HouseRules | None = None, scores: str = "") -> None:
    ThreadingHTTPServer((host, port), handler(Service(engine, audit, rules, token, scores))).serve_forever()
