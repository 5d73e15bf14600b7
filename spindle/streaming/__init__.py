from spindle.streaming.ingest import ingest_recordings, parse_batch, recording_lines

__all__ = ["ingest_recordings", "parse_batch", "recording_lines"]
