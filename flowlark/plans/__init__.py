"""flowlark.plans"""
