"""tidewire: PySpark jobs that turn news, prices and macro series into point-in-time signals."""
