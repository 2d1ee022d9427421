"""Speech-corpus analytics on Spark: manifests, alignments, prosody, captions and job state as DataFrames."""
