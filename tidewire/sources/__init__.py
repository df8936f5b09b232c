"""Series, spike trains, views of event tables, generators, and files."""
