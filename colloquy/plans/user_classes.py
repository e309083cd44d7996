"""What a user may bring: a data set over JSON lines and a sampler. Queries load it as a file."""

import json
from pathlib import Path


class JsonParts:
    """Rows of a folder of JSON lines, a part a file."""

    schema = "sample_id long, uid string, score double"

    def __init__(self, options):
        from pyarrow import fs

        uri = options["path"]
        self.fs, self.at = fs.FileSystem.from_uri(uri if ":" in uri else Path(uri).absolute().as_uri())

    def partitions(self):
        from pyarrow import fs

        return sorted(f.path for f in self.fs.get_file_info(fs.FileSelector(self.at)) if f.path.endswith(".json"))

    def rows(self, part):
        with self.fs.open_input_stream(part) as f:
            for line in f.read().decode().splitlines():
                x = json.loads(line)
                yield x["sample_id"], x["uid"], x["score"]


class NearestTo:
    """The scores nearest to a value first."""

    def __init__(self, value):
        self.value = value

    def key(self, rows):
        return (rows["score"] - self.value).abs()
