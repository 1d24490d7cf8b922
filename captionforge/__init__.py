"""Subtitles and transcripts from many recordings at once, as Spark DataFrame operators."""
