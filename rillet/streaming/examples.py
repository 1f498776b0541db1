"""Small plugins that the registered queries run."""

from __future__ import annotations

from rillet.streaming import plugins


class Counter(plugins.AnalysisPlugin):
    def process_message(self, msg, state, emit):
        state["count"] = state.get("count", 0) + 1
        return plugins.OK

    def timer_event(self, ns, shutdown, state, emit):
        emit.inject_payload("txt", "count", state["count"])


class Sorter(plugins.OutputPlugin):
    def process_message(self, msg, sequence):
        return -(sequence % 6) if sequence % 6 < 6 and sequence % 6 != 3 else plugins.RETRY
