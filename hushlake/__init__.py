"""hushlake: personal-data protection and text analytics on PySpark DataFrames."""
