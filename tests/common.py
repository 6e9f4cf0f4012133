"""What the tests of flows share."""

SF = "/root/testdata/sf0.001"


def rows(df, *cols, digits=6):
    def clean(v):
        return round(v, digits) + 0.0 if isinstance(v, float) else v

    picked = df.select(*cols) if cols else df
    return sorted((tuple(clean(v) for v in r) for r in picked.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))
