"""Sources and sinks: page tables, blobs, outlines, the index on disk, documents as JSON and text."""
