"""flowlark.sources"""
