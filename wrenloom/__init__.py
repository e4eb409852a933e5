"""wrenloom: crawl-frontier, task, playlist and transfer analytics on PySpark DataFrames."""
