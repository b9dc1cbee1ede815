"""Sources and sinks: term lists, corpora, detections, lexicons, texts, reports."""
