"""flowlark.functions"""
