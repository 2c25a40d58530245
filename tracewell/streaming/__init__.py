from tracewell.streaming.telemetry import event_stream, ingest_events

__all__ = ["event_stream", "ingest_events"]
