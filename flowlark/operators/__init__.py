"""flowlark.operators"""
