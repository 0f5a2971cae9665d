DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return df.collect()
