"""The same results in DuckDB SQL, used only to check the Spark results."""
